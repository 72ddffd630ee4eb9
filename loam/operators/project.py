"""Projections of ragged page and work records: pickers with fall-backs, metadata, routing of subpages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import clean, strip
from loam.functions.vector import similarity

from .assemble import first_text


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A path of a VARIANT as a type; null where it is missing or doesn't fit."""
    return F.try_variant_get(v, path, kind)


def seed_of(v: Column) -> Column:
    """The work that a record belongs to: its metadata's seed title, its seed, else its title or name."""
    return first_text(*[field(v, p) for p in ("$.metadata.seed_title", "$.meta.seed_title", "$.seed", "$.title", "$.name")])


def title_of(v: Column) -> Column:
    return first_text(*[field(v, p) for p in ("$.title", "$.name", "$.seed")])


def url_of(v: Column) -> Column:
    return first_text(*[field(v, p) for p in ("$.url", "$.source_url", "$.href")])


def summary_of(v: Column, keys: tuple[str, ...] = ("summary", "sum", "abstract", "요약"), sections: tuple[str, ...] = ("요약", "본문", "줄거리")) -> Column:
    """The first summary of a record (VARIANT): top-level keys, then the summary or text of sections."""
    paths = [f"$['{k}']" for k in keys]
    inner = [f"$.sections['{s}']{end}" for s in sections for end in (".summary", ".text", "")]
    # an object under a key isn't a summary
    texts = [F.when(F.schema_of_variant(F.coalesce(field(v, p, "variant"), F.parse_json(F.lit("null")))) == "STRING", field(v, p)) for p in paths + inner]
    return first_text(*texts)


def bullets_of(v: Column, keys: tuple[str, ...] = ("sum_bullets", "bullets"), most: int = 5) -> Column:
    """The first list under the keys: its strings, stripped, at most `most`."""
    found = F.coalesce(*[field(v, f"$['{k}']", "array<variant>") for k in keys])
    words = F.transform(F.filter(found, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: strip(field(x, "$")))
    return F.slice(F.filter(words, lambda x: x != ""), 1, most)


def characters_of(v: Column, path: str = "$.characters", most: int = 200) -> Column:
    """name, summary and the rest of at most `most` characters of a record, whatever their keys are called; nameless ones go."""
    items = F.coalesce(field(v, path, "array<variant>"), F.array().cast("array<variant>"))
    name = lambda x: first_text(field(x, "$.name"), field(x, "$.title"), field(x, "$['이름']"))
    about = lambda x: first_text(field(x, "$.summary"), field(x, "$.desc"), field(x, "$.description"), field(x, "$.text"))
    known = ("name", "title", "이름", "summary", "desc", "description", "text")
    rest = lambda x: F.map_filter(field(x, "$", "map<string, variant>"), lambda k, y: ~k.isin(*known) & y.isNotNull())
    all_ = F.transform(items, lambda x: F.struct(name(x).alias("name"), F.coalesce(about(x), F.lit("")).alias("summary"), F.to_json(F.transform_values(rest(x), lambda _, y: field(y, "$"))).alias("meta")))
    return F.slice(F.filter(all_, lambda c: c["name"].isNotNull()), 1, most)


def source_url(url: Column, section_urls: Column, body_urls: Column) -> Column:
    """The record's own address, else the first of its section's, else of its body's."""
    return first_text(url, F.get(section_urls, F.lit(0)), F.get(body_urls, F.lit(0)))


def without_nulls(meta: Column) -> Column:
    """A map without the keys whose values are null."""
    return F.map_filter(meta, lambda _, v: v.isNotNull())


def hit_items(hits: DataFrame, space: str = "cosine") -> DataFrame:
    """Items of an answer from hits (id, text, metadata map, distance, score): ids and texts as strings, the score from the
    distance where there is none, and the usual metadata as columns."""
    of = lambda k: F.element_at("metadata", F.lit(k)).alias(k)
    score = F.coalesce("score", similarity(F.col("distance"), space))
    names = ("page_id", "chunk_id", "url", "title", "section", "seed")
    return hits.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), *map(of, names), score.alias("score"), F.coalesce("text", F.lit("")).alias("text"))


def sections_present(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    return df.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections_present"))


def merged_metadata(df: DataFrame, key: str, order: str) -> DataFrame:
    """For each other column of a key its first value by `order` that isn't null or empty."""
    rest = [c for c in df.columns if c not in (key, order)]
    kept = lambda c: F.when(F.col(c).cast("string") != "", F.struct(order, c))
    return df.groupBy(key).agg(*[F.min(kept(c))[c].alias(c) for c in rest])


def prefix_summary(text: Column, most: int = 1000) -> Column:
    return F.substring(clean(text), 1, most)


def is_hub(title: Column, name: str = "등장인물") -> Column:
    return F.coalesce(strip(title) == name, F.lit(False))


def bucket_of(title: Column, parent: Column, has_list: Column, words: str = "등장인물|캐릭터|인물") -> Column:
    """Where a subpage goes: a list of characters, a character, the hub of characters, or another category."""
    both = F.concat_ws(" ", title, parent)
    return F.when(F.coalesce(has_list, F.lit(False)), "character_list").when(is_hub(title), "hub").when(both.rlike(words), "character").otherwise("other")


def subpages(df: DataFrame, hub_name: str = "등장인물(허브)") -> DataFrame:
    """Rows (seed, doc_title, title, parent, depth, text, has_list) that are subpages, with bucket, is_character and the hub renamed.

    The seed's own page (depth 0), pages of the seed's or document's title and such without text go.
    """
    t = strip(F.col("title"))
    rows = df.where((F.col("depth") > 0) & (F.coalesce(strip(F.col("text")), F.lit("")) != "") & (t != F.col("seed")) & (t != F.coalesce("doc_title", F.lit(""))))
    rows = rows.withColumn("bucket", bucket_of(F.col("title"), F.col("parent"), F.col("has_list")))
    rows = rows.withColumn("is_character", F.col("bucket") == "character")
    return rows.withColumn("title", F.when(is_hub(F.col("title")) & ~F.col("is_character"), hub_name).otherwise(F.col("title")))
