"""URL filters by dated lists: validity intervals of entries, and each capture against those in force when it was fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

#: A host that is an address, which has no domains above it.
ADDRESS = r"^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) from dated entries (pattern, category, action, day).

    An "add" holds from its day until the next entry of its pattern and category (until: null for ever); a "remove" ends
    it. Of several on one day the add counts. Entries with a null pattern, category or day are none; others than add and
    remove are ignored; repeated ones do no harm; other columns are left; without entries there are no intervals. A pattern
    is a host, which also stands for its subdomains, or a host and the first segments of a path: "example.org/a/b". It is
    read as a URL is, so scheme, user, port, upper case in the host, a last slash and what follows ? or # don't count; a
    pattern without a host is none. A host of one label ("localhost") and an address stand for themselves alone: no
    pattern blocks a top-level domain. Texts of any length count whole.
    """
    host, path = url_parts(F.col("pattern"))
    entries = entries.where("category IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    entries = entries.select(F.array_join(F.concat(F.array(host), path), "/").alias("pattern"), host.alias("host"), "category", "action", "day")
    known = entries.where("host IS NOT NULL")
    known = known.groupBy("pattern", "category", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    following = F.lead("day").over(Window.partitionBy("pattern", "category").orderBy("day"))
    return known.withColumn("until", following).where("on = 1").select("pattern", "category", F.col("day").alias("since"), "until")


def url_parts(url) -> tuple:
    """Host (lower case, without user, port and last dot; an IPv6 address in its brackets) and path segments of a URL column; the host is null if none."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    rest = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/@]*@)?(\[[^\]/]*\]|[^/:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    path = F.filter(F.split(F.regexp_extract(rest, r"^[^/]*(/.*)?$", 1), "/"), lambda s: s != "")
    return F.when(host != "", host), path


def keys_of(host, path):
    """All patterns that a URL falls under: its host and the domains above it (an address has none), each alone and with its path's first segments."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    names = F.transform(F.sequence(F.lit(1), F.when(host.rlike(ADDRESS), 1).otherwise(F.greatest(n - 1, F.lit(1)))), lambda k: F.array_join(F.slice(labels, k, n), "."))
    tails = F.concat(F.array(F.lit("")), F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(names, lambda a: F.transform(tails, lambda b: F.concat(a, b)))))


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture (id, url, fetched): id, fetched, host, n_entries, categories, pattern, blocked.

    n_entries counts the pairs of pattern and category in force on the day of the fetch, categories are sorted and joined
    by commas (empty: none), pattern is the longest of them (of equals the first; null: none). A null or hostless URL or a
    null day falls under none; a URL of any length is read whole; other columns, whatever their names, are left; an empty
    table gives an empty one. Intervals of one pattern and category don't overlap, so of each at most one row joins: an
    as-of join as an equality on the pattern and a range on the day. Captures are joined under each of their at most
    (labels - 1) * (segments + 1) patterns, segments being the most that an entry has, without their texts; Spark
    broadcasts the intervals where they are below its threshold, else both sides are sorted by pattern and adaptive execution splits what a hot domain makes too large.
    Rows that repeat an id are captures of their own.
    """
    host, path = url_parts(F.col("url"))
    active = written(intervals(entries))
    deepest = active.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit(""))))).first()[0] or 0
    rows = captures.select("id", "fetched", host.alias("host"), F.slice(path, 1, deepest).alias("path")).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows)
    keyed = rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("_row", "fetched", F.explode(keys_of(F.col("host"), F.col("path"))).alias("pattern"))
    met = keyed.join(active, "pattern").where("fetched >= since AND (until IS NULL OR fetched < until)")
    longest = F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("p")))["p"]
    found = met.groupBy("_row").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("c"), longest.alias("pattern"))
    out = rows.join(found, "_row", "left")
    return out.select("id", "fetched", "host", F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("c", F.lit("")).alias("categories"), "pattern", F.col("n").isNotNull().alias("blocked"))


def drawn(column, salt: str, modulus: int):
    """A number from 0 to modulus - 1 that md5 of the salt and column gives."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), column)), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def made_lists(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts and first path segments of pages; the test tables have no lists of their own."""
    host, path = url_parts(F.col("url"))
    above = F.regexp_replace(host, r"^[^.]+\.(?=[^.]+\.)", "")
    first = F.when(F.size(path) > 0, F.concat(host, F.lit("/"), F.get(path, F.lit(0))))
    names = pages.select(F.explode(F.array_distinct(F.filter(F.array(host, above, first), lambda x: x.isNotNull()))).alias("pattern")).distinct()
    p = F.col("pattern")
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), drawn(p, "c:", 3) + 1)
    added = F.date_add(F.lit("2024-01-01").cast("date"), drawn(p, "a:", 300))
    gone = F.date_add(added, 1 + drawn(p, "r:", 60))
    again = F.date_add(gone, 1 + drawn(p, "b:", 90))
    ends = drawn(p, "x:", 2) == 0
    step = lambda action, day: F.struct(F.lit(action).alias("action"), day.alias("day"))
    steps = [step("add", added), F.when(ends, step("remove", gone)), F.when(ends & (drawn(p, "y:", 2) == 0), step("add", again))]
    on = names.where(drawn(p, "l:", 5) == 0).select("pattern", category.alias("category"), F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("s"))
    return on.select("pattern", "category", "s.action", "s.day")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched on a day that their id gives, against dated lists made of their hosts; one row a page, as filtered has it.

    A null, empty or hostless URL and a null page_id (which gives no day) fall under no entry; URLs of any length are read
    whole; rows that repeat are pages of their own; other columns are left; an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    found = filtered(pages.select(F.col("page_id").alias("id"), "url", day.alias("fetched")), written(made_lists(pages)))
    return found.withColumnRenamed("id", "page_id").withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


_DRAWN = "(CAST('0x' || substr(md5('{0}' || pattern), 1, 8) AS BIGINT) % {1})"
OP3_SQL = rf"""
WITH r AS (
  SELECT page_id, regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '^[^?#]*', 0) AS rest,
    DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INT) AS fetched FROM pages
), u AS (
  SELECT page_id, fetched, nullif(regexp_replace(lower(regexp_extract(rest, '^(?:[^/@]*@)?(\[[^\]/]*\]|[^/:]*)', 1)), '\.$', ''), '') AS host,
    list_filter(str_split(regexp_extract(rest, '^[^/]*(/.*)?$', 1), '/'), lambda s: s <> '') AS path FROM r
), n AS (
  SELECT host AS pattern FROM u WHERE host IS NOT NULL
  UNION SELECT CASE WHEN len(str_split(host, '.')) > 2 THEN array_to_string(str_split(host, '.')[2:], '.') ELSE host END FROM u WHERE host IS NOT NULL
  UNION SELECT host || '/' || path[1] FROM u WHERE host IS NOT NULL AND len(path) > 0
), l AS (
  SELECT pattern, ['adult', 'malware', 'spam'][{_DRAWN.format("c:", 3)} + 1] AS category,
    DATE '2024-01-01' + CAST({_DRAWN.format("a:", 300)} AS INT) AS added, CAST(1 + {_DRAWN.format("r:", 60)} AS INT) AS r, CAST(1 + {_DRAWN.format("b:", 90)} AS INT) AS b,
    {_DRAWN.format("x:", 2)} = 0 AS x, {_DRAWN.format("y:", 2)} = 0 AS y FROM n WHERE {_DRAWN.format("l:", 5)} = 0
), e AS (
  SELECT pattern, category, added AS since, CASE WHEN x THEN added + r END AS until FROM l
  UNION ALL SELECT pattern, category, added + r + b, NULL FROM l WHERE x AND y
), k AS (
  SELECT page_id, fetched, unnest(list_distinct(flatten(list_transform(range(1, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN 1 ELSE greatest(len(str_split(host, '.')) - 1, 1) END + 1), lambda i:
    list_transform(range(0, len(path) + 1), lambda j: array_to_string(str_split(host, '.')[i:], '.') || CASE WHEN j = 0 THEN '' ELSE '/' || array_to_string(path[1:j], '/') END))))) AS pattern
  FROM u WHERE host IS NOT NULL
), m AS (SELECT page_id, pattern, category FROM k JOIN e USING (pattern) WHERE fetched >= since AND (until IS NULL OR fetched < until)),
g AS (
  SELECT page_id, COUNT(*) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS c, (list(pattern ORDER BY length(pattern) DESC, pattern))[1] AS pattern FROM m GROUP BY page_id
)
SELECT u.page_id, strftime(fetched, '%Y-%m-%d') AS fetched, host, COALESCE(n, 0) AS n_entries, COALESCE(c, '') AS categories, pattern, n IS NOT NULL AS blocked FROM u LEFT JOIN g USING (page_id)
"""
