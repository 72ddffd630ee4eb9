"""Keyed upserts over tables: new rows win, whole or field by field; state columns follow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orderable(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns whose type has an order: maps and variants, bare or inside others, have none."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return [c for c in columns if not re.search(r"\b(map<|variant)", kinds[c])]


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest `order` of each key, combined before the shuffle; of equals that of greatest other columns that have an order."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(order, *orderable(df, [c for c in rest if c != order]))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_b")).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose keys new lacks, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merged(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of both; of a key in both, `fields` from new where it has one, everything else from old."""
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_there"))
    o = old.withColumn("_was", F.lit(True))
    j = o.join(n, keys, "full")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        if c in fields:
            return F.coalesce(f"_n_{c}", c)
        return F.when(F.col("_was"), F.col(c)).otherwise(F.col(f"_n_{c}"))

    return j.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def replaced(chunks: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All chunks of the documents in new are replaced by new's, so no tail of an older version stays."""
    return upserted(chunks, new, [doc])


def page_state(pages: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """pages (doc_id, ...) with n_segments, vectorized = false and updated_at, as after new chunks were written."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"))
    out = pages.drop("n_segments", "vectorized", "vector_ts", "segment_ids").join(n, "doc_id", "left")
    return out.withColumn("n_segments", F.coalesce("n_segments", F.lit(0))).withColumn("vectorized", F.lit(False)).withColumn("updated_at", now)


def mark_vectorized(pages: DataFrame, vectors: DataFrame, now: Column) -> DataFrame:
    """pages whose chunks are in vectors (doc_id, id): vectorized, vector_ts and their ids in order."""
    ids = vectors.groupBy("doc_id").agg(F.array_sort(F.collect_list("id")).alias("segment_ids"))
    out = pages.drop("segment_ids", "vector_ts").join(ids, "doc_id", "left")
    done = F.col("segment_ids").isNotNull()
    return out.withColumn("vectorized", done).withColumn("vector_ts", F.when(done, now))


def embedded(rows: DataFrame, embed, text: str = "text", order: str | None = None, key: str = "id") -> DataFrame:
    """rows with `embedding` from embed(column). With `order`, of rows that repeat an id the one of greatest order counts."""
    if order is not None:
        rows = latest(rows, [key], order)
    return rows.withColumn("embedding", embed(F.col(text)))


def vectors_upserted(old: DataFrame, rows: DataFrame, embed, order: str, text: str = "text", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """A collection after rows (id, text, ...) were embedded and put in place of what had their ids, and the ids written."""
    new = embedded(rows, embed, text, order, key).select(*old.columns)
    return upserted(old, new, [key]), new.select(key)


def reembedded(source: DataFrame, embed, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A collection under another model, and one row of counts: src, moved."""
    out = embedded(source.drop("embedding"), embed, text)
    return out, source.agg(F.count(F.lit(1)).alias("src"), F.count(text).alias("moved"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row: empty where an index would be unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
