"""Queries over pages and texts made by rule, whose parts and chunks their SQL can tell: HTML, links, packers, noise, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import chunk, html, noise, registry, text
from loam.operators import assemble, crawl
from loam.plans.registry import query
from loam.sources.tables import table

#: A page by a document's number %1 and digest %2: what is dropped, a block, two boxes of links.
PAGE = (
    '<html><head><title>T</title><script>x()</script></head><body><nav><a href="/w/skip" title="skip">menu</a></nav><div class="top ad">buy</div>'
    '<div><h2>H%1</h2><p>%2</p><p>%2 &amp; more<br>of it</p></div><dl><a href="/w/S/%EB%93%B1%EC%9E%A5%EC%9D%B8%EB%AC%BC">list</a> <a href="/w/A%1" title="A%1">a</a>'
    '<a href="/w/B" title="B">b</a><a href="/w/A%1" title="A%1">again</a></dl><div><a href="/w/C" title="C">c</a><a href="/w/S/줄거리?x#y">plot</a></div></body></html>'
)


def _made(spark: SparkSession, d: str) -> DataFrame:
    k, digest = F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))
    page = F.replace(F.replace(F.lit(PAGE), F.lit("%1"), k), F.lit("%2"), digest)
    return table(spark, d, "documents").select("doc_id", F.replace(page, F.lit("/w/A" + "%1"), F.concat(F.lit("/w/A"), k)).alias("html"), F.when(F.col("doc_id") % 3 == 0, "http://x/w/%EB%93%B1%EC%9E%A5%EC%9D%B8%EB%AC%BC").otherwise("http://x/w/S").alias("url"))


@query("""WITH p AS (SELECT doc_id, 'H' || doc_id || chr(10) || md5(coalesce(text, '')) || chr(10) || md5(coalesce(text, '')) || ' & more' || chr(10) || 'of it' AS best FROM documents)
SELECT doc_id, md5('T' || chr(10) || best || chr(10) || array_to_string(['list', 'a', 'b', 'again', 'c', 'plot'], chr(10))) AS text, md5(best) AS best, 'H' || doc_id AS headings, 7 AS n_links, CASE WHEN doc_id % 3 = 0 THEN 'characters' ELSE 'page' END AS kind FROM p""")
def page_parts(spark, d):
    """Text without furniture, the best block, headings, links and the kind of pages."""
    p = _made(spark, d).select("doc_id", "url", html.parsed(F.col("html")).alias("p"))
    return p.select("doc_id", F.md5("p.text").alias("text"), F.md5("p.best").alias("best"), F.array_join("p.headings", "|").alias("headings"), F.size("p.links").alias("n_links"), html.page_kind(F.col("url"), F.col("p.headings")).alias("kind"))


@query("SELECT doc_id, 'skip|A' || doc_id || '|B|C' AS characters, 'A' || doc_id || '|B' AS strict, 'http://x/w/A' || doc_id AS first, '등장인물|줄거리' AS sections FROM documents")
def page_links(spark, d):
    """Links to characters, those beside the link to a list of characters only, and links to sections of a work."""
    p = _made(spark, d).select("doc_id", "url", html.parsed(F.col("html")).alias("p"), html.strict_character_links(F.col("html")).alias("s"))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["title"]), "|")
    each = p.select("doc_id", F.posexplode("p.links").alias("i", "l")).select("doc_id", "i", html.child_section(F.col("l.href"), F.lit("S"), ("등장인물", "줄거리")).alias("c")).where("c IS NOT NULL")
    sections = each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), "|").alias("sections"))
    return p.select("doc_id", names(html.character_links(F.col("p.links"))).alias("characters"), names(F.col("s")).alias("strict"), html.absolute(F.col("url"), F.get("s", F.lit(0))["href"]).alias("first")).join(sections, "doc_id")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 300 AS dst FROM orders), s AS (SELECT DISTINCT o_custkey AS page FROM orders WHERE o_custkey % 20 = 0),
a AS (SELECT DISTINCT dst AS page FROM e JOIN s ON src = page WHERE dst NOT IN (SELECT page FROM s)), b AS (SELECT DISTINCT dst AS page FROM e JOIN a ON src = page WHERE dst NOT IN (SELECT page FROM s) AND dst NOT IN (SELECT page FROM a))
SELECT page, 0 AS depth FROM s UNION ALL SELECT page, 1 FROM a UNION ALL SELECT page, 2 FROM b""")
def reached_pages(spark, d):
    """Two steps along links, each page once."""
    o = table(spark, d, "orders")
    links = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 300).alias("dst")).distinct()
    return crawl.reached(o.where("o_custkey % 20 = 0").select(F.col("o_custkey").alias("page")), links, 2, "page")


# packers: sentences of 100 signs, so that chunks can be counted out

_SENTENCE = "lpad(CAST(i AS VARCHAR), 3, '0') || repeat('가', 96) || '.'"
_TEXTS = f"t AS (SELECT doc_id, 1 + doc_id % 40 AS n FROM documents), s AS (SELECT doc_id, n, unnest(range(0, n)) AS i FROM t), x AS (SELECT doc_id, n, i, {_SENTENCE} AS s FROM s)"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i: F.concat(F.lpad(i.cast("string"), 3, "0"), F.lit("가" * 96 + "."))
    n = F.pmod(F.col("doc_id"), F.lit(40)).cast("int")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), n), one), " ").alias("text"))


@query(f"""WITH {_TEXTS}, c AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 8) / 6.0) AS BIGINT) + 1 END)) AS k FROM t)
SELECT doc_id, CAST(k AS INT) AS k, md5(string_agg(s, ' ' ORDER BY i)) AS digest FROM c JOIN x USING (doc_id) WHERE i >= 6 * k AND i < 6 * k + 8 GROUP BY doc_id, k""")
def packed_sentences(spark, d):
    """Eight sentences a chunk, of which the last two begin the next."""
    rows = _sentences(spark, d)
    return rows.select("doc_id", F.posexplode(chunk.sentence_chunks(F.col("text"))).alias("k", "c")).select("doc_id", "k", F.md5("c").alias("digest"))


@query(f"""WITH {_TEXTS}, c AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 8) / 7.0) AS BIGINT) + 1 END)) AS k FROM t),
g AS (SELECT doc_id, k, string_agg(s, ' ' ORDER BY i) AS g FROM c JOIN x USING (doc_id) WHERE i >= CASE WHEN k = 0 THEN 0 ELSE 1 + 7 * k END AND i < 8 + 7 * k GROUP BY doc_id, k),
p AS (SELECT doc_id, k, CASE WHEN k = 0 THEN g ELSE right((SELECT string_agg(s, ' ' ORDER BY i) FROM x WHERE x.doc_id = g.doc_id AND i < 1 + 7 * k), 120) || ' ' || g END AS text FROM g)
SELECT doc_id, CAST(k AS INT) AS k, md5(text) AS digest FROM p""")
def packed_with_tail(spark, d):
    """Sentences of which a full chunk's last 120 signs begin the next."""
    rows = _sentences(spark, d)
    return rows.select("doc_id", F.posexplode(chunk.tail_chunks(F.col("text"))).alias("k", "c")).select("doc_id", "k", F.md5("c").alias("digest"))


@query("""WITH t AS (SELECT doc_id, 9 * (1 + doc_id % 5) AS n FROM documents), l AS (SELECT doc_id, unnest(range(0, n)) AS i FROM t), x AS (SELECT doc_id, i, lpad(CAST(i AS VARCHAR), 3, '0') || repeat('나', 27) AS line FROM l),
s AS (SELECT doc_id, i // 3 AS j, string_agg(line, ' ' ORDER BY i) AS s FROM x GROUP BY doc_id, i // 3), m AS (SELECT doc_id, 2 * (j // 3) + CASE WHEN j % 3 = 2 THEN 1 ELSE 0 END AS k, string_agg(s, chr(10) ORDER BY j) AS c FROM s GROUP BY doc_id, k)
SELECT doc_id, CAST(k AS INT) AS k, md5(c) AS digest FROM m""")
def stitched_lines(spark, d):
    """Lines of 30 signs between noise: three are stitched, two of these merged, the third stands alone."""
    line = lambda i: F.concat(F.lpad(i.cast("string"), 3, "0"), F.lit("나" * 27), F.lit("\nhttps://example.com\n \nx\n"))
    n = (9 * (F.pmod(F.col("doc_id"), F.lit(5)) + 1) - 1).cast("int")
    rows = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), n), line), "").alias("text"))
    chunks = chunk.merge_small(chunk.stitch_short(chunk.clean_lines(F.col("text"))))
    return rows.select("doc_id", F.posexplode(chunks).alias("k", "c")).select("doc_id", "k", F.md5("c").alias("digest"))


@query("SELECT doc_id, md5(substring(repeat('다', 50) || doc_id || chr(10) || chr(10) || repeat('라', 60 + doc_id % 50), 1, 120)) AS digest FROM documents")
def joined_blocks(spark, d):
    """Blocks without noise lines; short ones go, the rest is joined and cut."""
    k = F.col("doc_id")
    blocks = F.array(F.concat(F.lit("다" * 50), k.cast("string"), F.lit("\nwww.x.com\n")), F.lit("짧다"), F.concat(F.lit("x\n"), F.repeat(F.lit("라"), (60 + k % 50).cast("int"))))
    return table(spark, d, "documents").select("doc_id", F.md5(chunk.paragraphs(blocks, 40, 120)).alias("digest"))


# noise, furniture, summaries

LINES = r"""d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS x FROM d),
f AS (SELECT *, length(x) AS n, len(regexp_extract_all(x, '[A-Za-z]')) AS latin, len(regexp_extract_all(x, '\p{L}')) AS letters FROM l),
g AS (SELECT *, latin / n AS ratio, CASE WHEN letters > 0 THEN latin / letters ELSE 0 END AS share,
  regexp_matches(x, '(?i)©|all\s+rights\s+reserved') AS legal, regexp_matches(x, '(?i)protected by recaptcha|hcaptcha.*(terms|privacy policy)|apply\.|su zona horaria es') AS captcha,
  regexp_matches(x, '(?i)^(facebook|instagram|tiktok|twitter|youtube|x([^\pL\pN_]|$))') AS site, regexp_matches(x, '(?i)(https?://|www\.)[\w.\-]+\.[a-z]{2,}') AS url,
  regexp_matches(x, '[\pL\pM\pN_\-]+(\.[\pL\pM\pN_\-]+)+') AS domain, regexp_matches(x, '\b0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}\b') AS phone, regexp_matches(x, '[CO]BT\b') AS game FROM f)"""


@query(rf"""WITH {LINES}, b AS (SELECT *, legal OR captcha OR site OR url OR domain OR phone AS family, regexp_matches(x, '(?i)^(©|all\s+rights\s+reserved|protected by recaptcha|hcaptcha.*(terms|privacy policy)|apply\.|su zona horaria es)') OR site AS anchored,
  len(regexp_extract_all(x, 'https?://|www\.')) / (len(regexp_extract_all(x, ' ')) + 1) AS urls FROM g)
SELECT doc_id, COUNT(*) FILTER (n < 2 OR share > 0.82 OR family OR game) AS strict, COUNT(*) FILTER (n < 2 OR anchored OR url OR domain OR phone) AS old, COUNT(*) FILTER (family) AS block, COUNT(*) FILTER (n < 10 OR ratio > 0.7 OR contains(lower(x), 'google')) AS light,
COUNT(*) FILTER (game) AS game, COUNT(*) FILTER (NOT regexp_matches(x, '[0-9A-Za-z]') OR ratio > 0.8 OR urls > 0.15) AS low FROM b GROUP BY doc_id""")
def noise_lines_full(spark, d):
    """All tests of noise on the lines of the test texts, which are in Latin letters: the Korean families have no say there."""
    lines = assemble.text_lines(table(spark, d, "documents"), "doc_id")
    x = F.col("line")
    tests = {"strict": noise.is_noise_line(x), "old": noise.is_noise_line_old(x), "block": noise.is_noise_block(x), "light": noise.is_light_noise(x), "game": noise.is_game_notice(x), "low": noise.is_low_quality(x, F.lit(""))}
    return lines.groupBy("doc_id").agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


def visible_sql(c: str) -> str:
    c = rf"regexp_replace(regexp_replace({c}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '[ \t\x{{00A0}}]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def deleted_sql(c: str, patterns: list[str]) -> str:
    for p in patterns:
        c = f"regexp_replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return c


@query(rf"""WITH v AS (SELECT doc_id, text, {visible_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, {deleted_sql("t", text.FURNITURE)} AS t FROM v), s AS (SELECT *, regexp_split_to_array(t, '\r\n|\r|\n') AS ls FROM w)
SELECT doc_id, md5(CASE WHEN t <> '' AND len(list_filter(ls, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) <= 30)) / len(ls) >= 0.6 THEN '' ELSE regexp_replace(t, '^\s+|\s+$', '', 'g') END) AS furniture,
md5(trim(regexp_replace({deleted_sql("text", text.LICENSE_SPANS)}, '\s+', ' ', 'g'))) AS spans, md5(trim(regexp_replace(regexp_replace(text, '\[\d+\]', '', 'g'), '\s+', ' ', 'g'))) AS uncited FROM s""")
def furniture(spark, d):
    """Texts without page furniture, without spans of licences and advertisements, without citation marks."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    t = F.col("text")
    return rows.select("doc_id", F.md5(text.without_furniture(t)).alias("furniture"), F.md5(text.without_license_spans(t)).alias("spans"), F.md5(text.without_citations(t)).alias("uncited"))


_SENTENCES = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, t, {_SENTENCES.format("substring(t, 1, 3000)")} AS s, {_SENTENCES.format("substring(CASE WHEN doc_id % 3 = 0 THEN '[평가] ' || t ELSE '[본문] ' || t || chr(10) || chr(10) || '[설정] x.' END, 1, 3000)")} AS w, {_SENTENCES.format("substring(t, 1, 1200)")} AS b FROM t WHERE t <> '')
SELECT doc_id, trim(substring(s[1], 1, 280)) AS section, trim(substring(w[1], 1, 280)) AS document, array_to_string(list_transform(w[1:3], lambda x: trim(substring(x, 1, 120))), '|') AS bullets,
array_to_string(list_transform(CASE WHEN len(b) = 1 THEN [b[1], b[1]] ELSE b[1:2] END, lambda x: '• ' || trim(substring(x, 1, 120))), '|') AS two FROM s""")
def work_summaries(spark, d):
    """Summaries of a section and of a whole work, and two bullets, under the stand-in model."""
    t = text.squashed(F.col("text"))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t")).where("t <> ''")
    t = F.col("t")
    sections = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("평가"), t)).otherwise(F.create_map(F.lit("설정"), F.lit("x."), F.lit("본문"), t))
    whole = registry.document_summary(sections)
    return rows.select("doc_id", registry.section_summary(t).alias("section"), whole["text"].alias("document"), F.array_join(whole["bullets"], "|").alias("bullets"), F.array_join(registry.two_bullets(t), "|").alias("two"))
