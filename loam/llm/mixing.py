"""Mixing of sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import boxed, ranked, running, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and how many times its size a source or document may be taken at most.
SHARE, MOST = 1.5, 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes. A target stops at `most`
    times its source's size and the excess is shared again by weight: target = min(most * size, level * weight), where
    level is found over the sources in order of most * size / weight. Sources, however many, are ranked and summed in
    ranges; two sums and the level pass through the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = running(per.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], ["_one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_before__one") % len(weights) + 1).cast("int")).cast("double")
    per = per.select("source", "source_size", "n_docs", weight.alias("_w"), (F.col("source_size") * most).cast("double").alias("_cap"))
    ladder = running(per.withColumn("_r", F.col("_cap") / F.col("_w")), [F.col("_r").asc(), F.col("source").asc_nulls_last()], ["_cap", "_w"])
    size, all_ = ladder.agg(F.sum("source_size"), F.sum("_w")).first()
    if size is None:
        return ladder.select("source", "source_size", "n_docs", F.col("_cap").alias("target"))
    level = (F.lit(size * share) - F.col("_before__cap")) / (F.lit(all_) - F.col("_before__w"))
    found = ladder.where(level <= F.col("_r")).agg(F.min(F.struct("_r", level.alias("level")))["level"]).first()[0]
    found = float("inf") if found is None else found
    return ladder.select("source", "source_size", "n_docs", F.least("_cap", F.lit(found) * F.col("_w")).alias("target"))


def systematic_mix(docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = (), **rules) -> DataFrame:
    """docs (doc_id, source, size) with source_size, target and copies: how often the mix takes each document.

    A document's expected copies are target / source_size, the same throughout a source. In order of (size, doc_id) the
    prefix sums of these, plus one offset that md5 of seed and source gives, cross an integer boundary once for every
    copy, so each document is taken its expected copies, rounded up or down, with the chances that make up the
    expectation. Ordering by size makes neighbours alike: the words taken come within one document (the source's largest)
    of the target. A source without words has target 0 and no copies; null sources are a source; null and empty texts have
    size 0; texts of any length count whole; rows repeated in docs, or of equal size and id, are taken on their own in an
    order that doesn't matter to the words taken; columns named in `keep` are carried along, others left; an empty table
    gives an empty one. Only counts a range and a source meet in one task.
    """
    narrow = written(docs.select("doc_id", "source", "size", *keep))
    targets = source_targets(narrow.select("source", "size"), **rules).withColumnRenamed("source", "_s")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), F.col("_s")), F.lit("null")))
    offset = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    targets = written(targets.select("_s", "source_size", "target", expected.alias("_e"), offset.alias("_u")))
    at = ranked(narrow, "source", [F.col("size").asc(), F.col("doc_id").asc_nulls_first()], "_at")
    out = at.join(targets, at["source"].eqNullSafe(targets["_s"]))
    copies = F.floor((F.col("_at") + 1) * F.col("_e") + F.col("_u")) - F.floor(F.col("_at") * F.col("_e") + F.col("_u"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *keep)


def with_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, the columns `keep`, and size: the number of runs of bytes that aren't white space (null text: 0)."""
    return docs.select("doc_id", "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0 and give no words; a null source is a source; long texts count whole; rows that repeat
    are taken on their own; other columns are left; an empty table gives no rows. Reruns agree.
    """
    mix = systematic_mix(with_sizes(table(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as the mix takes it, all its columns as they are, whatever their names.

    Null, empty and long texts, null sources, repeated rows and an empty docs as in systematic_mix.
    """
    rows = boxed(docs)
    mix = systematic_mix(with_sizes(rows.select("_doc.doc_id", "_doc.source", "_doc.text", "_row"), "_row"), keep=("_row",))
    mix = mix.where("copies > 0").select("_row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_copy"))
    return rows.join(mix, "_row").select("_doc.*")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST(place % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM per
), r AS (SELECT *, cap / w AS r FROM w),
l AS (
  SELECT *, (SUM(source_size) OVER () * CAST(1.5 AS DOUBLE)
    - COALESCE(SUM(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, LEAST(cap, COALESCE((SELECT arg_min(level, r) FROM l WHERE level <= r), CAST('inf' AS DOUBLE)) * w) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    CAST(CAST('0x' || substr(md5('mix-1:' || COALESCE('s' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM t
),
n AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM d
)
SELECT doc_id, size, source_size, target, size * CAST(floor((k + 1) * e + u) - floor(k * e + u) AS BIGINT) AS taken
FROM n JOIN e ON n.source IS NOT DISTINCT FROM e.source
"""
