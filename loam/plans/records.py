"""Queries over records, chunks and collections made of the test tables, for the operators that those tables don't call for.

What a query reads is made of documents, orders or embeddings by rules that its SQL repeats; names are Korean where the
operators look for Korean names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import chunk, noise, text
from loam.operators import assemble, metrics, project, rank, upsert
from loam.plans.registry import query
from loam.sources import jsonl, tables
from loam.sources.tables import table

SECTIONS = ("본문", "줄거리", "설정", "등장인물", "요약", "평가", "잡담", "방영 정보")
PARENTS = ("", "등장인물", "설정", "인물", "개요", "그 밖")
TITLES = ("등장인물", "평가", "이름", "세계관", "src1", "등장 인물 목록", "캐릭터", "소개")


def pick(names: tuple[str, ...], c: Column) -> Column:
    """One of the names by a whole number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))


def pick_sql(names: tuple[str, ...], c: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({c} % {len(names)} + 1 AS INT)]"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# sources and sinks


@query("SELECT doc_id, source, lang, n_chars, text FROM documents WHERE doc_id % 7 <> 3")
def jsonl_tolerant(spark, d):
    """Documents written as JSON lines, some of them damaged; the reader skips those."""
    where = tables.shared_folder(spark)
    good = F.to_json(F.struct("doc_id", "source", "lang", "n_chars", "text"), {"ignoreNullFields": "false"})
    lines = docs(spark, d).select(F.when(F.col("doc_id") % 7 == 3, F.lit('{"doc_id": 1, "sour')).otherwise(good).alias("value"))
    lines.write.text(where)
    return jsonl.read(spark, where, "doc_id long, source string, lang string, n_chars long, text string", files="*.txt")


@query("SELECT doc_id, source, lang, n_chars, text FROM documents")
def jsonl_strict(spark, d):
    """Documents through the writer and the reader that fails on a bad line."""
    where = tables.shared_folder(spark)
    jsonl.write(docs(spark, d).select("doc_id", "source", "lang", "n_chars", "text"), where)
    return jsonl.read(spark, where, "doc_id long, source string, lang string, n_chars long, text string", "fail")


@query("SELECT line_no, o_orderkey AS k, o_orderkey % 5 = 2 AS fault FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, o_orderkey FROM orders) WHERE o_orderkey % 3 <> 1")
def jsonl_numbered(spark, d):
    """Line numbers of good and bad lines of one file with blank lines in it."""
    where = tables.shared_folder(spark)
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 1, "  ").when(k % 5 == 2, F.format_string("{bad %d", k)).otherwise(F.to_json(F.struct(k.alias("k"))))
    tables.write_one_text(table(spark, d, "orders").orderBy("o_orderkey").select(value.alias("value")), where)
    good = jsonl.read_numbered(spark, where, "k long", "*.txt").select("line_no", "k", F.lit(False).alias("fault"))
    bad = jsonl.faults(spark, where, "*.txt").select("line_no", F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("k"), F.lit(True).alias("fault"))
    return good.unionByName(bad)


@query("SELECT source AS \"group\", doc_id AS title, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS pos FROM (SELECT source, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE source IS NOT NULL)")
def title_lists(spark, d):
    """A JSON object of lists, one a source."""
    where = tables.shared_folder(spark)
    per = docs(spark, d).where("source IS NOT NULL").groupBy("source").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("t"))
    one = per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "t")))).alias("value"))
    one.coalesce(1).write.text(where)
    return jsonl.read_titles(spark, where)


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def encoded_texts(spark, d):
    """Texts in UTF-16 and UTF-8 files, which the reader tells apart, line by line JSON; more texts make more files, not larger ones."""
    where = tables.shared_folder(spark)
    rows = docs(spark, d).where("text IS NOT NULL").select("doc_id", "text")
    for k, encoding in enumerate(("UTF-16", "UTF-8")):
        rows.where(F.col("doc_id") % 2 == k).write.option("maxRecordsPerFile", 500).option("encoding", encoding).option("lineSep", "\n").mode("append").json(where)
    files = jsonl.read_text(spark, f"{where}/*.json")
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    row = F.from_json("line", "doc_id long, text string")
    return lines.select(row.alias("r")).select("r.doc_id", F.md5("r.text").alias("digest"))


@query(r"SELECT regexp_replace(substring(seed, 1, 180), '[\"*/:<>?\\|]', '_', 'g') AS file, COUNT(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '/a:b?' ELSE '' END AS seed, doc_id FROM documents WHERE source IS NOT NULL) GROUP BY ALL")
def files_by_seed(spark, d):
    where = tables.shared_folder(spark)
    rows = docs(spark, d).where("source IS NOT NULL").select("doc_id", F.concat("source", F.when(F.col("doc_id") % 2 == 0, "/a:b?").otherwise("")).alias("seed"))
    jsonl.write_by_seed(rows, where)
    back = spark.read.schema("doc_id long, seed string, file string").json(where)
    return back.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 = 1")
def jsonl_append(spark, d):
    """Two writes to one folder, the second an append."""
    where = tables.shared_folder(spark)
    for k, mode in enumerate(("overwrite", "append")):
        jsonl.write(docs(spark, d).where(F.col("doc_id") % 3 == k).select("doc_id", "lang", "n_chars"), where, mode)
    return jsonl.read(spark, where, "doc_id long, lang string, n_chars long")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 = 0 OR vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10)")
def collection_reads(spark, d):
    """A collection written and read again: rows by id, and its first rows."""
    where = tables.shared_folder(spark)
    tables.write_collection(table(spark, d, "embeddings").select("vec_id", "label"), where)
    c = spark.read.parquet(where)
    wanted = c.where("vec_id % 5 = 0").select("vec_id")
    return tables.by_ids(c, wanted.unionByName(wanted), "vec_id").unionByName(tables.peek(c, 10, "vec_id")).distinct()


# state of pages and collections


@query("""WITH n AS (SELECT o_custkey, COUNT(*) AS n, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey % 2 = 0)), '|') AS ids FROM orders GROUP BY o_custkey)
SELECT c_custkey AS doc_id, coalesce(n, 0) AS n_segments, ids IS NOT NULL AND ids <> '' AS vectorized, nullif(ids, '') AS ids, CASE WHEN ids <> '' THEN 2 END AS vector_ts, 1 AS updated_at FROM customer LEFT JOIN n ON c_custkey = o_custkey""")
def page_states(spark, d):
    """Pages (customers) after new chunks (orders) were written, and after the even ones were embedded."""
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"))
    written = upsert.page_state(pages, chunks, F.lit(1))
    out = upsert.mark_vectorized(written, chunks.where("id % 2 = 0"), F.lit(2))
    return out.select("doc_id", "n_segments", "vectorized", F.array_join("segment_ids", "|").alias("ids"), "vector_ts", "updated_at")


@query("""WITH new AS (SELECT o_custkey AS id, max_by(o_orderkey, o_orderkey) AS ts FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
SELECT c_custkey AS id, CASE WHEN ts IS NULL THEN 'old' ELSE 'text ' || ts END AS text, CASE WHEN ts IS NULL THEN 0 ELSE length('text ' || ts) END AS size, ts IS NOT NULL AS written FROM customer LEFT JOIN new ON c_custkey = id""")
def vector_upsert(spark, d):
    """Rows that repeat ids, embedded and put in a collection: the last of an id counts, and the ids written come back."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("text"), F.array(F.lit(0.0)).alias("embedding"))
    rows = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.concat(F.lit("text "), F.col("o_orderkey").cast("string")).alias("text"), F.col("o_orderkey").alias("ts"))
    out, ids = upsert.vectors_upserted(old, rows, lambda c: F.array(F.length(c).cast("double")), "ts")
    out = out.join(ids.withColumn("written", F.lit(True)), "id", "left")
    return out.select("id", "text", F.get("embedding", F.lit(0)).cast("int").alias("size"), F.coalesce("written", F.lit(False)).alias("written"))


@query("SELECT COUNT(*) AS src, COUNT(text) AS moved, CAST(sum(length(text)) AS BIGINT) AS size FROM documents")
def reembed(spark, d):
    """A collection moved to another model, with the counts of the move."""
    source = docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.array(F.lit(0.0)).alias("embedding"))
    out, counts = upsert.reembedded(source, lambda c: F.array(F.length(c).cast("double")))
    return counts.join(out.agg(F.sum(F.get("embedding", F.lit(0))).cast("long").alias("size")))


# records and their fields

RECORDS = """CASE pmod(doc_id, 4)
  WHEN 0 THEN concat('{"summary": " s', doc_id, ' ", "bullets": ["a", 1, " b ", "", "c", "d", "e", "f"], "title": "t", "url": "u', doc_id, '"}')
  WHEN 1 THEN concat('{"title": " ", "name": "n', doc_id, '", "sections": {"본문": {"text": "body', doc_id, '"}}, "sum_bullets": ["x"], "href": "h"}')
  WHEN 2 THEN concat('{"summary": {"no": 1}, "seed": "s', doc_id, '", "meta": {"seed_title": "m', doc_id, '"}, "source_url": " v "}')
  ELSE concat('{"name": null, "sections": {"요약": "plain', doc_id, '", "줄거리": 5}, "metadata": {"seed_title": "d', doc_id, '"}}') END"""


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 's' || doc_id WHEN 1 THEN 'body' || doc_id WHEN 3 THEN 'plain' || doc_id END AS summary, CASE doc_id % 4 WHEN 0 THEN 'a|b|c|d|e' WHEN 1 THEN 'x' END AS bullets,
CASE doc_id % 4 WHEN 0 THEN 't' WHEN 1 THEN 'n' || doc_id WHEN 2 THEN 'm' || doc_id ELSE 'd' || doc_id END AS seed, CASE doc_id % 4 WHEN 0 THEN 't' WHEN 1 THEN 'n' || doc_id WHEN 2 THEN 's' || doc_id END AS title,
CASE doc_id % 4 WHEN 0 THEN 'u' || doc_id WHEN 1 THEN 'h' WHEN 2 THEN 'v' END AS url FROM documents""")
def record_pickers(spark, d):
    """Summary, bullets, seed, title and address of records whose keys differ."""
    rows = docs(spark, d).select("doc_id", F.parse_json(F.expr(RECORDS)).alias("v"))
    v = F.col("v")
    return rows.select("doc_id", project.summary_of(v).alias("summary"), F.array_join(project.bullets_of(v), "|").alias("bullets"), project.seed_of(v).alias("seed"), project.title_of(v).alias("title"), project.url_of(v).alias("url"))


@query("""WITH c AS (SELECT doc_id, unnest(range(0, doc_id % 4)) AS i FROM documents)
SELECT doc_id, 'c' || doc_id || '_' || i AS name, CASE WHEN i = 1 THEN 'about' ELSE '' END AS summary, CAST(i AS VARCHAR) AS rest FROM c WHERE i <> 2""")
def record_characters(spark, d):
    """Characters of records under various keys; those without a name go."""
    item = lambda i: F.concat(F.lit('{"'), F.when(i == 0, "name").when(i == 1, "title").when(i == 2, "nobody").otherwise("이름"), F.lit('": "c'), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"), F.lit('", "'), F.when(i == 1, "desc").otherwise("n"), F.lit('": "'), F.when(i == 1, "about").otherwise(""), F.lit('", "rest": '), i.cast("string"), F.lit("}"))
    items = F.transform(F.sequence(F.lit(0), F.lit(3)), item)
    some = F.slice(items, F.lit(1), F.pmod(F.col("doc_id"), F.lit(4)).cast("int"))
    rows = docs(spark, d).select("doc_id", F.parse_json(F.concat(F.lit('{"characters": ['), F.array_join(some, ", "), F.lit("]}"))).alias("v"))
    each = rows.select("doc_id", F.explode(project.characters_of(F.col("v"))).alias("c"))
    return each.select("doc_id", "c.name", "c.summary", F.get_json_object("c.meta", "$.rest").alias("rest"))


@query("""WITH m AS (SELECT source, lang, doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE 'd' || doc_id END AS note, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS size FROM documents WHERE source IS NOT NULL)
SELECT source, arg_min(note, doc_id) FILTER (note <> '') AS note, arg_min(size, doc_id) FILTER (size IS NOT NULL) AS size, array_to_string(list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)), ',') AS present FROM m GROUP BY source""")
def metadata_first_wins(spark, d):
    """For each source its first metadata that isn't blank, and the sections (languages) present."""
    note = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = docs(spark, d).where("source IS NOT NULL").select("source", "doc_id", note.alias("note"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("size"))
    present = project.sections_present(docs(spark, d).where("source IS NOT NULL").select("source", F.col("lang").alias("section")), "source").withColumnRenamed("sections_present", "present")
    return project.merged_metadata(rows, "source", "doc_id").join(present, "source")


@query(r"""SELECT doc_id, CASE WHEN n_chars IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_kept, CASE WHEN doc_id % 3 = 0 THEN 'n' ELSE 'lang,n' END AS keys, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1000) AS summary,
coalesce(CASE WHEN doc_id % 4 = 0 THEN 'own' END, CASE WHEN doc_id % 4 = 1 THEN 'section' END, CASE WHEN doc_id % 4 <> 3 THEN 'body' END) AS address FROM documents WHERE text IS NOT NULL""")
def record_cleanup(spark, d):
    """Metadata without nulls, a summary from the text's beginning, and the first address there is."""
    rows = docs(spark, d).where("text IS NOT NULL")
    k = F.col("doc_id") % 4
    meta = project.without_nulls(F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))))
    address = project.source_url(F.when(k == 0, "own").otherwise(" "), F.when(k == 1, F.array(F.lit("section"))).otherwise(F.array().cast("array<string>")), F.when(k != 3, F.array(F.lit("body"))))
    return rows.select("doc_id", F.size(meta).alias("n_kept"), F.array_join(F.array_sort(F.map_keys(meta)), ",").alias("keys"), project.prefix_summary(F.col("text")).alias("summary"), address.alias("address"))


@query(f"""WITH p AS (SELECT doc_id, {pick_sql(PARENTS, 'doc_id')} AS parent, {pick_sql(TITLES, 'doc_id // 2')} AS title, {pick_sql(SECTIONS, 'doc_id')} AS name FROM documents)
SELECT doc_id, CASE parent WHEN '' THEN '본문' WHEN '인물' THEN '등장인물' WHEN '개요' THEN '줄거리' ELSE parent END AS by_parent,
CASE WHEN parent <> '' AND title IN ('등장인물', '캐릭터') THEN '등장인물' WHEN parent <> '' AND title = '세계관' THEN '설정' ELSE '본문' END AS by_title,
CASE WHEN parent <> '' AND title IN ('등장인물', '캐릭터', '세계관') THEN parent ELSE title END AS shown,
CASE name WHEN '줄거리' THEN '본문' WHEN '잡담' THEN '본문' WHEN '방영 정보' THEN '본문' ELSE name END AS standard,
CASE WHEN regexp_matches(parent || ' ' || title, '등장인물|캐릭터|인물') THEN '등장인물' WHEN regexp_matches(parent || ' ' || title, '설정|세계관') THEN '설정' ELSE '기타' END AS category FROM p""")
def section_names(spark, d):
    """The section of a page by its parent, by its title, by the import's names, and its category."""
    rows = docs(spark, d).select("doc_id", pick(PARENTS, F.col("doc_id")).alias("parent"), pick(TITLES, F.expr("doc_id div 2")).alias("title"), pick(SECTIONS, F.col("doc_id")).alias("name"))
    by = assemble.section_by_title(F.col("title"), F.col("parent"), {"등장인물": "등장인물", "캐릭터": "등장인물", "세계관": "설정"})
    return rows.select("doc_id", assemble.section_of(F.col("parent")).alias("by_parent"), by["section"].alias("by_title"), by["title"].alias("shown"), assemble.standard_section(F.col("name")).alias("standard"), assemble.category_of(F.col("parent"), F.col("title")).alias("category"))


@query(f"""WITH p AS (SELECT doc_id, source AS seed, 'src2' AS doc_title, {pick_sql(TITLES, 'doc_id // 2')} AS title, {pick_sql(PARENTS, 'doc_id')} AS parent, doc_id % 3 AS depth, doc_id % 11 = 0 AS has_list, text FROM documents),
k AS (SELECT *, CASE WHEN has_list THEN 'character_list' WHEN title = '등장인물' THEN 'hub' WHEN regexp_matches(title || ' ' || parent, '등장인물|캐릭터|인물') THEN 'character' ELSE 'other' END AS bucket FROM p WHERE depth > 0 AND trim(coalesce(text, '')) <> '' AND title <> seed AND title <> doc_title)
SELECT doc_id, CASE WHEN title = '등장인물' AND bucket <> 'character' THEN '등장인물(허브)' ELSE title END AS title, bucket, bucket = 'character' AS is_character FROM k""")
def subpage_routing(spark, d):
    """Subpages of a work: its own page goes, hubs are renamed, characters are told from lists and the rest."""
    rows = docs(spark, d).select("doc_id", F.col("source").alias("seed"), F.lit("src2").alias("doc_title"), pick(TITLES, F.expr("doc_id div 2")).alias("title"), pick(PARENTS, F.col("doc_id")).alias("parent"), (F.col("doc_id") % 3).cast("int").alias("depth"), (F.col("doc_id") % 11 == 0).alias("has_list"), "text")
    return project.subpages(rows).select("doc_id", "title", "bucket", "is_character")


@query(f"""WITH p AS (SELECT doc_id, {pick_sql(TITLES, 'doc_id // 2')} AS title, {pick_sql(PARENTS, 'doc_id')} AS parent, CASE WHEN doc_id % 2 = 0 THEN '기타' ELSE '설정' END AS category, doc_id % 3 AS depth FROM documents)
SELECT doc_id, CASE WHEN category = '기타' AND regexp_matches(title || ' ' || parent, '등장인물|캐릭터|인물') THEN '등장인물' ELSE category END AS category, category = '기타' AND regexp_matches(title || ' ' || parent, '등장인물|캐릭터|인물') AS is_character,
parent = '등장인물' OR depth >= 2 AND title <> 'src1' AND title NOT IN ('평가', '세계관') AS character_page, title IN ('평가', '세계관') AS no_character FROM p""")
def misc_promotion(spark, d):
    """Pages of the other category that read like characters, and the tests of character pages and names."""
    rows = docs(spark, d).select("doc_id", pick(TITLES, F.expr("doc_id div 2")).alias("title"), pick(PARENTS, F.col("doc_id")).alias("parent"), F.when(F.col("doc_id") % 2 == 0, "기타").otherwise("설정").alias("category"), (F.col("doc_id") % 3).alias("depth"))
    out = assemble.promoted(rows)
    t = F.col("title")
    return out.select("doc_id", "category", "is_character", noise.is_character_page(t, F.col("parent"), F.col("depth"), F.lit("src1")).alias("character_page"), noise.is_no_character(t).alias("no_character"))


@query("SELECT doc_id, length(trim(text)) >= 20 AS described FROM documents WHERE text IS NOT NULL AND length(trim(text)) >= 20")
def described_characters(spark, d):
    rows = docs(spark, d).where("text IS NOT NULL").select("doc_id", F.col("text").alias("desc"))
    return assemble.described(rows).select("doc_id", F.lit(True).alias("described"))


# documents of sections


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of works: source is the seed, eight sections in turn."""
    rows = docs(spark, d).where("source IS NOT NULL AND text IS NOT NULL")
    title = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), (F.col("doc_id") % 3).cast("string")))
    return rows.select(F.col("source").alias("seed"), title.alias("title"), pick(SECTIONS, F.col("doc_id")).alias("section"), F.col("doc_id").cast("int").alias("pos"), "doc_id", F.md5("text").alias("chunk"), F.concat(F.lit("u"), (F.col("doc_id") % 4).cast("string")).alias("url"))


CHUNKS = f"""c AS (SELECT source AS seed, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'T' || doc_id % 3 END AS title, {pick_sql(SECTIONS, 'doc_id')} AS section, doc_id AS pos, doc_id, md5(text) AS chunk, 'u' || doc_id % 4 AS url FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
o AS (SELECT seed, section, chunk, min(pos) AS pos FROM c GROUP BY ALL),
s AS (SELECT seed, section, string_agg(chunk, chr(10) || chr(10) ORDER BY pos) AS text, COUNT(*) AS n FROM o GROUP BY ALL),
u AS (SELECT seed, section, list_sort(list(DISTINCT url)) AS urls FROM c GROUP BY ALL),
p AS (SELECT s.*, urls, coalesce(list_position(['요약', '본문', '줄거리', '설정', '등장인물', '평가', '에피소드', '방영'], section), 9) AS place FROM s JOIN u USING (seed, section))"""


@query(f"""WITH {CHUNKS}, t AS (SELECT seed, coalesce(min(nullif(title, '')), seed) AS title FROM c GROUP BY seed)
SELECT seed, title, string_agg(section, ',' ORDER BY place, section) AS section_order, md5(string_agg(text, '|' ORDER BY place, section)) AS digest, max(array_to_string(urls, ',')) FILTER (section = '본문') AS urls FROM p JOIN t USING (seed) GROUP BY seed, title""")
def work_assembly(spark, d):
    """Works of several sections: title, order of sections, texts and addresses."""
    out = assemble.assembled(_chunks(spark, d).drop("doc_id"))
    parts = F.transform("section_order", lambda s: F.element_at("sections", s)["text"])
    return out.select("seed", "title", F.array_join("section_order", ",").alias("section_order"), F.md5(F.array_join(parts, "|")).alias("digest"), F.array_join(F.element_at("sections", F.lit("본문"))["urls"], ",").alias("urls"))


@query(f"""WITH {CHUNKS} SELECT seed, section, CAST(row_number() OVER (PARTITION BY seed ORDER BY place, section) - 1 AS INT) AS seg_index, md5(text) AS digest FROM p WHERE section <> '요약'""")
def section_segments(spark, d):
    """Sections as segments of a document in their order, numbered throughout, the summary left out."""
    rows = assemble.flattened(assemble.assembled(_chunks(spark, d).drop("doc_id")), "seed").where("section <> '요약'")
    n = F.row_number().over(rank.Window.partitionBy("seed").orderBy("section_pos", "section")) - 1
    return rows.select("seed", "section", n.alias("seg_index"), F.md5("text").alias("digest"))


def _works(spark: SparkSession, d: str) -> DataFrame:
    made = assemble.assembled(_chunks(spark, d).drop("doc_id"))
    sections = F.transform_values("sections", lambda k, v: F.struct(v["text"].alias("text"), F.when(k == "요약", F.lit("short")).alias("summary"), v["urls"].alias("urls")))
    return made.select(F.col("seed").alias("doc_id"), "title", "seed", F.when(F.col("seed") == "src1", F.lit("own")).alias("url"), sections.alias("sections"))


@query(f"""WITH {CHUNKS}, b AS (SELECT seed, urls[1] AS body FROM p WHERE section = '본문')
SELECT seed AS doc_id, section, CASE WHEN section <> '요약' THEN md5(text) END AS digest, CASE WHEN section = '요약' THEN 'short' END AS summary, CASE WHEN seed = 'src1' THEN 'own' ELSE coalesce(urls[1], body) END AS source_url FROM p LEFT JOIN b USING (seed) WHERE section NOT IN ('잡담', '방영 정보')""")
def section_export(spark, d):
    """The export's rows: sections to keep, summaries apart, an address each."""
    out = assemble.exported(_works(spark, d))
    return out.select("doc_id", "section", F.md5("text").alias("digest"), "summary", "source_url")


@query(f"WITH {CHUNKS} SELECT section, COUNT(*) AS n FROM p WHERE section IN ('잡담', '방영 정보') GROUP BY section ORDER BY n DESC, section LIMIT 20")
def section_leftovers(spark, d):
    """The commonest names of sections that the export leaves out."""
    return assemble.other_sections(_works(spark, d))


LISTED = ("re:^[a-f]+\\s", " THE ", "# a comment", "", "re:que$", "Ich bin")


@query(r"""WITH d AS (SELECT doc_id, lang AS section, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, section, unnest(ls) AS chunk, generate_subscripts(ls, 1) AS pos FROM d)
SELECT doc_id, section, md5(string_agg(chunk, chr(10) || chr(10) ORDER BY pos)) AS digest, COUNT(*) AS n FROM l
WHERE NOT (contains(lower(chunk), 'the') OR contains(lower(chunk), 'ich bin') OR regexp_matches(chunk, '(?i)^[a-f]+\s') OR regexp_matches(chunk, '(?i)que$')) GROUP BY ALL""")
def listed_boilerplate(spark, d):
    """Sections without the chunks that a list of texts and patterns names."""
    where = tables.shared_folder(spark)
    spark.createDataFrame([(x,) for x in LISTED], "value string").coalesce(1).write.text(where)
    chunks = assemble.text_lines(docs(spark, d), "doc_id", "lang").select("doc_id", F.col("lang").alias("section"), "pos", F.col("line").alias("chunk"))
    out = assemble.without_listed(chunks, jsonl.read_patterns(spark, where))
    return out.select("doc_id", "section", F.md5("text").alias("digest"), "n")


@query("SELECT COUNT(*) AS total, COUNT(*) FILTER (n > 0) AS kept, COUNT(*) FILTER (n = 0 AND word) AS rescued FROM (SELECT len(list_filter(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: length(x) >= 500)) AS n, contains(lower(coalesce(source, '')), 'src1') OR contains(lower(coalesce(lang, '')), 'fr') AS word FROM documents WHERE text IS NOT NULL)")
def keyword_rescue(spark, d):
    """Documents that a filter of lines empties, and those of them that a keyword in their metadata keeps."""
    rows = docs(spark, d).where("text IS NOT NULL").select(F.size(F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.length(x) >= 500)).alias("n"), noise.has_keyword(["SRC1", "fr"], F.col("source"), F.col("lang")).alias("word"))
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("kept"), F.count_if((F.col("n") == 0) & F.col("word")).alias("rescued"))


# titles, queries, prompts


@query(r"""WITH t AS (SELECT doc_id, 'My ' || source || ' (' || lang || ')!' AS t, lang || '-' || source AS s FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
b AS (SELECT *, trim(regexp_replace(regexp_replace(t, '\([^()]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS bare, trim(regexp_replace(regexp_replace(t, '!', '', 'g'), '\s+', ' ', 'g')) AS plain, regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g') AS k FROM t)
SELECT doc_id, t || '|' || bare || '|' || replace(t, ' ', '') || '|' || plain || '|' || k || '|' || s || '|' || regexp_replace(s, '-', '', 'g') AS aliases, t || '|' || t || ' 요약|' || t || ' 줄거리|' || t || ' 등장인물|' || bare AS queries,
t || '|' || lower(k) || CASE WHEN contains(t, 'src1') THEN '|first source' ELSE '' END AS variants, trim(t || ' x') AS cited FROM b""")
def title_spellings(spark, d):
    """Aliases of a title, queries made of it, variants of it as a query, and a title without citation marks."""
    rows = docs(spark, d).where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.concat(F.lit("My "), "source", F.lit(" ("), "lang", F.lit(")!")).alias("t"), F.concat("lang", F.lit("-"), "source").alias("s"))
    t = F.col("t")
    rows = rows.select("doc_id", "t", text.title_aliases(t, F.col("s")).alias("a"), text.query_variants(t, {"src1": ["first source", "x"]}, False).alias("v"))
    return rows.select("doc_id", F.array_join("a", "|").alias("aliases"), F.array_join(text.made_queries(t, F.slice("a", 2, 1)), "|").alias("queries"), F.array_join("v", "|").alias("variants"), text.without_citations(F.concat("t", F.lit(" [12] x"))).alias("cited"))


@query("""WITH h AS (SELECT source AS qid, doc_id, lang, substring(text, 1, 1200) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
s AS (SELECT qid, rank, '[S' || rank || '] ' || doc_id || ' · ' || coalesce(lang, '') || chr(10) || t AS item FROM h WHERE rank <= 8), e AS (SELECT *, sum(length(item)) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM s)
SELECT qid, COUNT(*) AS n, md5(string_agg(item, chr(10) || chr(10) ORDER BY rank)) AS digest FROM e WHERE upto <= 6000 GROUP BY qid""")
def prompt_context(spark, d):
    """Numbered sources of a prompt, cut at 1,200 signs each and 6,000 together."""
    rows = docs(spark, d).where("source IS NOT NULL AND text IS NOT NULL").select(F.col("source").alias("qid"), F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("section"), "text", "doc_id")
    top = rank.ranked(rows, "doc_id").where("rank <= 8")
    per = top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "section", "text"))), lambda x: F.struct(x["title"].alias("title"), x["section"].alias("section"), x["text"].alias("text"))).alias("items"))
    shown = chunk.context_text(F.col("items"))
    return per.select("qid", (F.size(F.split(shown, r"(?:^|\n\n)\[S\d+\] ")) - 1).cast("long").alias("n"), F.md5(shown).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL), n AS (SELECT *, length(t) AS n FROM t WHERE length(t) > 0),
w AS (SELECT doc_id, 'section' AS kind, unnest(range(0, CAST(greatest(0, ceil((n - 1600) / 1450.0)) AS BIGINT) + 1)) AS k, 1450 AS step, 1600 AS size, source, lang, t FROM n
UNION ALL SELECT doc_id, 'tokens', unnest(range(0, CAST(greatest(0, ceil((n - 1440) / 1080.0)) AS BIGINT) + 1)), 1080, 1440, source, lang, t FROM n)
SELECT doc_id, kind, CAST(k AS INT) AS k, md5(CASE kind WHEN 'section' THEN '[' || source || '] · [' || lang || ']' || chr(10) || '[' || lang || '] ' || substring(t, k * step + 1, size) ELSE 'part-' || k || substring(t, k * step + 1, size) END) AS digest FROM w""")
def labelled_windows(spark, d):
    """Windows with their section in front and their title before it, and windows by tokens with their part's label."""
    rows = docs(spark, d).where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    a = rows.select("doc_id", "source", "lang", F.lit("section").alias("kind"), F.posexplode(chunk.labelled_windows(F.col("text"), F.col("lang"))).alias("k", "w"))
    b = rows.select("doc_id", F.lit("tokens").alias("kind"), F.posexplode(chunk.token_windows(F.col("text"))).alias("k", "w"))
    return a.select("doc_id", "kind", "k", F.md5(chunk.with_title(F.col("source"), F.col("lang"), F.col("w"))).alias("digest")).unionByName(b.select("doc_id", "kind", "k", F.md5(F.concat("w.part", "w.text")).alias("digest")))


@query(r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 50)) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, unnest(range(0, CAST(greatest(0, ceil((length(line) - 300) / 300.0)) AS BIGINT) + 1)) AS k FROM l), p AS (SELECT DISTINCT doc_id, trim(substring(line, k * 300 + 1, 300)) AS piece FROM w)
SELECT doc_id, COUNT(*) AS n, md5(string_agg(piece, '|' ORDER BY piece)) AS digest FROM p WHERE length(piece) >= 50 GROUP BY doc_id""")
def line_pieces(spark, d):
    """Lines of 50 signs at least in pieces of 300, each once."""
    rows = docs(spark, d).where("text IS NOT NULL").select("doc_id", chunk.line_chunks(F.col("text")).alias("c")).where("size(c) > 0")
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("c"), "|")).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array('- ' || text, '\r\n|\r|\n'), lambda x: trim(regexp_replace(regexp_replace(x, '^\s*(?:[-*•·▪]|\d+[.)])\s*', ''), '^\s+|\s+$', '', 'g'))), lambda x: x <> '')[1:5], '|') AS bullets FROM documents WHERE text IS NOT NULL""")
def bullet_lines(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.array_join(text.bullets(F.concat(F.lit("- "), "text")), "|").alias("bullets"))


@query("SELECT doc_id, CAST(doc_id AS INT) AS a, 'x' || doc_id AS b FROM documents")
def model_json(spark, d):
    """What a model wrote as JSON, damaged in several ways."""
    i = F.col("doc_id").cast("string")
    made = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"a": '), i, F.lit(', "b": "x'), i, F.lit('"}')))
    made = made.when(F.col("doc_id") % 4 == 1, F.concat(F.lit('Here:\n```json\n{"a": '), i, F.lit(', "b": "x'), i, F.lit('",}\n```')))
    made = made.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("{a: "), i, F.lit(", b: “x"), i, F.lit("”} so"))).otherwise(F.concat(F.lit('{"a": '), i, F.lit(', /* b */ "b": "x'), i, F.lit('"} // end')))
    return docs(spark, d).select("doc_id", text.repaired_json(made, "a int, b string").alias("r")).select("doc_id", "r.a", "r.b")


# measures and ranking


@query("""SELECT doc_id, doc_id % 3 = 0 AS by_id, doc_id % 4 = 1 AS by_title, doc_id % 5 = 2 AS by_url FROM documents""")
def gold_matching(spark, d):
    """Hits against the wanted ids, titles and addresses, blanks and stray white space among them."""
    k = F.col("doc_id")
    rows = docs(spark, d).select("doc_id", F.array(F.lit("no"), F.when(k % 3 == 0, k.cast("string")).otherwise("other")).alias("ids"), F.when(k % 4 == 1, " t ").when(k % 4 == 2, " ").otherwise("other").alias("gt"), F.when(k % 4 == 2, "").otherwise("t").alias("t"), F.when(k % 5 == 2, "u").alias("gu"), F.lit(" u ").alias("u"))
    m = lambda mode: metrics.gold_match(mode, k, F.col("t"), F.col("u"), F.col("ids"), F.col("gt"), F.col("gu"))
    return rows.select("doc_id", m("chunk").alias("by_id"), m("title").alias("by_title"), m("page").alias("by_url"))


@query("""WITH k AS (SELECT coalesce(CAST(CASE WHEN doc_id % 4 <> 0 THEN doc_id // 4 END AS VARCHAR), CAST(doc_id AS VARCHAR)) AS key, doc_id, source FROM documents WHERE lang = 'en'), f AS (SELECT key, min(doc_id) AS id, arg_min(source, doc_id) AS title FROM k GROUP BY key)
SELECT key, id, title, CAST(row_number() OVER (ORDER BY md5('42:' || key), key) AS INT) AS place FROM f QUALIFY place <= 50""")
def document_sample(spark, d):
    """A seeded sample of distinct documents of a section, for an evaluation."""
    rows = docs(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.expr("doc_id div 4")).alias("doc_id"), F.col("source").alias("title"), F.col("lang").alias("section"))
    return metrics.sampled_documents(rows, 50, "en")


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS INT) AS page, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 10 AS INT) AS line FROM orders")
def pages_of_ten(spark, d):
    return rank.paged(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", by="o_custkey")


@query("SELECT v AS id, 'p' || vec_id AS page_id, NULL AS chunk_id, CAST(label AS VARCHAR) AS title, round(CASE WHEN vec_id % 2 = 0 THEN 0.25 ELSE greatest(0, least(1, 1 - vec_id % 7 / 2)) END, 6) AS score, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'x' END AS text FROM (SELECT CAST(vec_id AS VARCHAR) AS v, vec_id, label FROM embeddings)")
def answer_items(spark, d):
    """Hits as an answer's items; scores are made of distances where there are none."""
    e = table(spark, d, "embeddings")
    meta = F.create_map(F.lit("page_id"), F.concat(F.lit("p"), F.col("vec_id").cast("string")), F.lit("title"), F.col("label").cast("string"))
    hits = e.select(F.col("vec_id").alias("id"), meta.alias("metadata"), F.when(F.col("vec_id") % 2 == 0, 0.25).alias("score"), (F.col("vec_id") % 7).alias("distance"), F.when(F.col("vec_id") % 3 != 0, "x").alias("text"))
    return project.hit_items(hits).select("id", "page_id", "chunk_id", "title", F.round("score", 6).alias("score"), "text")
