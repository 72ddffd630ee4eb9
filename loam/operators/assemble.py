"""From cleaned lines and pages to documents: boilerplate, first-of-key rules, sections, attachment of related rows."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import strip

from .upsert import orderable

SECTION_ORDER = tuple("요약 본문 줄거리 설정 등장인물 평가 에피소드 방영".split())
#: Other names under which a section goes.
SECTION_NAMES = {other: name for name, others in (("방영", ["방영 정보"]), ("평가", ["반응"]), ("설정", ["세계관"]), ("줄거리", ["시놉시스", "개요"]), ("등장인물", ["인물", "캐릭터"])) for other in others}


def first_text(*columns: Column) -> Column:
    """The first column that isn't blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns])


def section_of(parent: Column, names: dict[str, str] = SECTION_NAMES, default: str = "본문") -> Column:
    """The section that a page's parent names, by its usual name; without a parent the body."""
    p = F.nullif(strip(parent), F.lit(""))
    out = p
    for k, v in names.items():
        out = F.when(p == k, v).otherwise(out)
    return F.coalesce(out, F.lit(default))


#: Section names of an import's records, and the five sections they go to.
STANDARD_NAMES = {"개요": "요약", "소개": "요약", "시놉시스": "본문", "스토리": "본문", "줄거리": "본문", "인물": "등장인물", "캐릭터": "등장인물", "세계관": "설정", "반응": "평가"}
STANDARD = ("요약", "본문", "등장인물", "설정", "평가")


def section_by_title(title: Column, parent: Column, names: dict[str, str], default: str = "본문") -> Column:
    """section and title of a page: with a parent, a title that is one of the names gives the section and the parent the title."""
    under = F.coalesce(parent, F.lit("")) != ""
    named = F.lit(None).cast("string")
    for k, v in names.items():
        named = F.when(strip(title) == k, v).otherwise(named)
    hit = under & named.isNotNull()
    own = F.coalesce(F.nullif(title, F.lit("")), parent, F.lit(""))
    return F.struct(F.when(hit, named).otherwise(default).alias("section"), F.when(hit, parent).otherwise(own).alias("title"))


def standard_section(name: Column, default: str = "본문") -> Column:
    """One of the five standard sections, by the name's usual meaning; any other name is the body."""
    out = F.when(name.isin(*STANDARD), name)
    for k, v in STANDARD_NAMES.items():
        out = out.when(name == k, v)
    return out.otherwise(default)


def category_of(parent: Column, title: Column) -> Column:
    both = F.concat_ws(" ", parent, title)
    return F.when(both.rlike("등장인물|캐릭터|인물"), "등장인물").when(both.rlike("설정|세계관"), "설정").otherwise("기타")


def section_place(section: Column, order: tuple[str, ...] = SECTION_ORDER) -> Column:
    place = F.array_position(F.array(*map(F.lit, order)), section)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def text_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, pos and line: the non-blank lines of text, stripped, pos from 0 among them."""
    lines = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), strip), lambda x: x != "")
    return docs.where("text IS NOT NULL").select(*keep, F.posexplode(lines).alias("pos", "line"))


def common_lines(lines: DataFrame, group: str, least: int = 5, most: int = 80) -> DataFrame:
    """Lines of at most `most` signs that stand in `least` different groups: (line, n_groups, n). Counted twice over, with partial sums."""
    short = lines.where(F.length("line") <= most)
    per = short.groupBy("line", group).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("line").agg(F.count(group).alias("n_groups"), F.sum("n").alias("n")).where(F.col("n_groups") >= least)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, then by the other columns that have an order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order, *orderable(df, [c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_b")).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest])


def longest_of(df: DataFrame, group: str, length: Column, k: int, tie: str) -> DataFrame:
    """The k rows of a group of greatest length; rows past k go before the shuffle."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(length.desc(), tie))
    return df.withColumn("rank", n).where(F.col("rank") <= k)


def with_sections(lines: DataFrame, heading: Column, doc: str = "doc_id") -> DataFrame:
    """Each line under the last heading before it in its document (null: none yet); heading lines themselves go."""
    upto = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_h", heading).withColumn("section", F.last("_h", ignorenulls=True).over(upto)).where("_h IS NULL").drop("_h")


def assembled(chunks: DataFrame, seed: str = "seed") -> DataFrame:
    """One row a seed from (seed, title, section, pos, chunk, url): title, section_order and sections.

    Chunks that repeat within a section count once, where they stand first; sections come in the usual order, then by
    name; urls are sorted. A document is one row in the end, so its parts must fit one; groups are by seed and section first.
    """
    once = chunks.groupBy(seed, "section", "chunk").agg(F.min("pos").alias("pos"), F.collect_set("url").alias("urls"), F.min(F.nullif("title", F.lit(""))).alias("title"))
    per = once.groupBy(seed, "section").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.min("title").alias("title"))
    per = per.withColumn("chunks", F.transform("parts", lambda x: x["chunk"]))
    section = F.struct(section_place(F.col("section")).alias("place"), "section", F.array_join("chunks", "\n\n").alias("text"), "chunks", "urls")
    docs = per.groupBy(seed).agg(F.sort_array(F.collect_list(section)).alias("s"), F.min("title").alias("title"))
    body = F.map_from_entries(F.transform("s", lambda x: F.struct(x["section"], F.struct(x["text"].alias("text"), x["chunks"].alias("chunks"), x["urls"].alias("urls")))))
    return docs.select(seed, F.coalesce("title", F.col(seed).cast("string")).alias("title"), F.transform("s", lambda x: x["section"]).alias("section_order"), body.alias("sections"))


def flattened(docs: DataFrame, *keep: str) -> DataFrame:
    """Sections as rows: `keep`, section, text, in the usual order by section_pos."""
    rows = docs.select(*keep, F.explode(F.map_entries("sections")).alias("e"))
    return rows.select(*keep, F.col("e.key").alias("section"), F.col("e.value.text").alias("text"), section_place(F.col("e.key")).alias("section_pos"))


#: Sections that an export keeps.
KEPT_SECTIONS = ("요약", "본문", "줄거리", "등장인물", "설정", "평가")


def exported(docs: DataFrame, keep: tuple[str, ...] = KEPT_SECTIONS) -> DataFrame:
    """Rows of an export from docs (doc_id, title, seed, url, sections): the sections to keep; the summary's text is its summary.

    sections: map of struct<text, summary, urls>. source_url is the record's, else the section's first, else the body's.
    """
    body = F.element_at("sections", F.lit("본문"))["urls"]
    rows = docs.select("doc_id", "title", "seed", F.col("url"), body.alias("_b"), F.explode(F.map_entries("sections")).alias("e")).where(F.col("e.key").isin(*keep))
    short = F.col("e.key") == "요약"
    text, summary = F.col("e.value.text"), F.nullif(F.col("e.value.summary"), F.lit(""))
    urls = F.col("e.value.urls")
    address = first_text(F.col("url"), F.get(urls, F.lit(0)), F.get("_b", F.lit(0)))
    return rows.select("doc_id", "title", "seed", F.col("e.key").alias("section"), F.when(~short, text).alias("text"), F.when(short, F.coalesce(summary, F.nullif(text, F.lit("")))).alias("summary"), address.alias("source_url"))


def other_sections(docs: DataFrame, keep: tuple[str, ...] = KEPT_SECTIONS, most: int = 20) -> DataFrame:
    """The commonest names of sections that an export leaves out, with their counts; of equal counts by name."""
    names = docs.select(F.explode(F.map_keys("sections")).alias("section")).where(~F.col("section").isin(*keep))
    return names.groupBy("section").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "section").limit(most)


def matches_listed(c: Column, texts: list[str], patterns: list[str]) -> Column:
    """Whether a chunk holds one of the texts, or something a pattern matches, in whatever case."""
    found = F.lit(False)
    for t in texts:
        found = found | F.contains(F.lower(c), F.lit(t.lower()))
    for p in patterns:
        found = found | c.rlike(f"(?iu){p}")
    return found


def without_listed(chunks: DataFrame, listed: DataFrame, most: int = 10_000) -> DataFrame:
    """Chunks (doc_id, section, pos, chunk) as sections (doc_id, section, text, n) without those that a list (kind, pattern) names.

    The list is a file that people write, so it comes to the driver; one of over `most` entries is refused. Sections, and so
    documents, of which nothing is left go.
    """
    rules = [tuple(r) for r in listed.select("kind", "pattern").limit(most + 1).collect()]
    if len(rules) > most:
        raise ValueError(f"a list of over {most} entries")
    bad = matches_listed(F.col("chunk"), [p for k, p in rules if k == "text"], [p for k, p in rules if k == "regex"])
    per = chunks.where(~bad).groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("c"))
    return per.select("doc_id", "section", F.array_join(F.transform("c", lambda x: x["chunk"]), "\n\n").alias("text"), F.size("c").cast("long").alias("n"))


def described(characters: DataFrame, least: int = 20) -> DataFrame:
    """Characters (…, desc) whose description has at least `least` signs."""
    return characters.where(F.length(strip(F.coalesce("desc", F.lit("")))) >= least)


def promoted(pages: DataFrame, words: str = "등장인물|캐릭터|인물", other: str = "기타", to: str = "등장인물") -> DataFrame:
    """pages (category, title, parent, ...) with those of the other category that read like characters in the characters' one."""
    hit = (F.col("category") == other) & (F.coalesce("title", F.lit("")).rlike(words) | F.coalesce("parent", F.lit("")).rlike(words))
    flag = F.col("is_character") if "is_character" in pages.columns else F.lit(False)
    return pages.withColumn("is_character", hit | flag).withColumn("category", F.when(hit, to).otherwise(F.col("category")))


def attached(left: DataFrame, right: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """left with an array of the items of right under its key, sorted; empty where there is none."""
    many = right.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
    return left.join(many, key, "left").withColumn(name, F.coalesce(name, F.array()))


def updated(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join on the keys; of `columns` the new value if there is one, else the old."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = old.join(fresh, keys, "full")
    return out.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns], *[c for c in old.columns if c not in keys + columns])


def summary_targets(docs: DataFrame) -> DataFrame:
    """Which documents (doc_id, body_len, summary_len, n_bullets) need a summary, and why; short bodies are left alone."""
    missing, short = F.coalesce("summary_len", F.lit(0)) == 0, F.coalesce("summary_len", F.lit(0)).between(1, 119)
    reason = F.concat_ws(",", F.when(missing, "no_summary"), F.when(short, "short_summary"), F.when(F.coalesce("n_bullets", F.lit(0)) != 5, "bullets"))
    body = F.coalesce("body_len", F.lit(0))
    return docs.where(~((body > 0) & (body < 300))).withColumn("reason", reason).where("reason <> ''")


def scalar_metadata(c: Column, kind) -> Column:
    """A metadata value as one string: lists joined by bars, structs and maps as JSON, the rest as text."""
    if kind.typeName() == "array":
        return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return F.to_json(c) if kind.typeName() in ("struct", "map") else c.cast("string")


def containing(texts: DataFrame, phrases: DataFrame, block: int = 50_000) -> DataFrame:
    """(id, phrase_id) for each text (id, text) and phrase (phrase_id, phrase) that it contains.

    Phrases go through the texts in blocks of `block`, each one automaton that finds all of its phrases in one pass, so
    time is linear in the texts for each block, whatever the number of phrases in it, and the driver holds one block.
    """
    known = phrases.where("phrase <> ''").select("phrase_id", "phrase")
    n = known.count()
    out = None
    for b in range(max(1, -(-n // block))):
        some = [tuple(r) for r in known.where(F.pmod(F.xxhash64("phrase_id"), F.lit(max(1, -(-n // block)))) == b).collect()]

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            by: dict[str, list[int]] = {}
            for i, p in some:
                by.setdefault(p, []).append(i)
            automaton = ahocorasick.Automaton()
            for p in by:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in batches:
                ids, found = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if by and text.is_valid:
                        for p in {p for _, p in automaton.iter(text.as_py())}:
                            ids += [i] * len(by[p])
                            found += by[p]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["id", "phrase_id"])

        part = texts.select("id", "text").mapInArrow(run, "id long, phrase_id long")
        out = part if out is None else out.unionByName(part)
    return out
