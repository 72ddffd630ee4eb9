import datetime as dt

import duckdb

from loam.llm.url_filters import OP3_SQL, filtered, intervals, op3_url_filters

D = dt.date
ENTRIES = "pattern string, category string, action string, day date"
CAPTURES = "id long, url string, fetched date"


def run(spark, captures, entries):
    out = filtered(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    return {r["id"]: (r["blocked"], r["n_entries"], r["categories"], r["pattern"]) for r in out}


def test_intervals_follow_adds_and_removals(spark):
    rows = [("a.org", "spam", "add", D(2024, 1, 5)), ("a.org", "spam", "add", D(2024, 1, 5)), ("a.org", "spam", "remove", D(2024, 2, 1)), ("a.org", "spam", "add", D(2024, 3, 1)), ("a.org", "adult", "remove", D(2024, 1, 1)), (None, "x", "add", D(2024, 1, 1)), ("b.org", None, "add", D(2024, 1, 1)), ("b.org", "x", "add", None), ("c.org", "x", "what", D(2024, 1, 1)), ("d.org", "x", "remove", D(2024, 1, 1)), ("d.org", "x", "add", D(2024, 1, 1))]
    got = sorted(map(tuple, intervals(spark.createDataFrame(rows, ENTRIES)).collect()), key=str)
    assert got == sorted([("a.org", "spam", D(2024, 1, 5), D(2024, 2, 1)), ("a.org", "spam", D(2024, 3, 1), None), ("d.org", "x", D(2024, 1, 1), None)], key=str)


def test_entries_in_force_on_the_day(spark):
    entries = [("a.org", "spam", "add", D(2024, 1, 5)), ("a.org", "spam", "remove", D(2024, 2, 1)), ("x.a.org/p/q", "adult", "add", D(2024, 1, 1)), ("org", "all", "add", D(2024, 1, 1))]
    captures = [
        (1, "https://x.A.org:80/p/q/r?s#t", D(2024, 1, 10)),  # both
        (2, "http://a.org", D(2024, 1, 4)),  # the day before
        (3, "http://a.org", D(2024, 1, 5)),
        (4, "http://user@a.org./", D(2024, 1, 31)),
        (5, "http://a.org", D(2024, 2, 1)),  # removed that day
        (6, "http://ba.org/p/q", D(2024, 1, 10)),  # not a subdomain
        (7, None, D(2024, 1, 10)),
        (8, "http://a.org", None),
        (9, "", D(2024, 1, 10)),
        (10, "https://x.a.org/p/qq", D(2024, 3, 1)),  # a segment must match whole
        (None, "http://a.org", D(2024, 1, 6)),
    ]
    got = run(spark, captures, entries)
    assert got[1] == (True, 2, "adult,spam", "x.a.org/p/q")
    assert got[3] == got[4] == got[None] == (True, 1, "spam", "a.org")
    assert all(got[k] == (False, 0, "", None) for k in (2, 5, 6, 7, 8, 9, 10))


def test_empty_tables_and_repeated_rows(spark):
    one = (1, "http://a.org", D(2024, 1, 1))
    assert run(spark, [], [("a.org", "s", "add", D(2024, 1, 1))]) == {}
    assert run(spark, [one], []) == {1: (False, 0, "", None)}
    df = spark.createDataFrame([one, one], CAPTURES)
    assert filtered(df, spark.createDataFrame([("a.org", "s", "add", D(2023, 1, 1))], ENTRIES)).where("blocked").count() == 2


def test_entries_of_many_segments(spark):
    path = "".join(f"/s{k}" for k in range(12))
    day = D(2024, 1, 1)
    got = run(spark, [(1, f"http://a.org{path}/x", day), (2, f"http://a.org{path}", day), (3, f"http://a.org{path[:-1]}", day)], [(f"a.org{path}", "spam", "add", day)])
    assert got[1] == got[2] == (True, 1, "spam", f"a.org{path}") and got[3] == (False, 0, "", None)


def test_entries_are_read_as_urls_are(spark):
    day = D(2024, 1, 1)
    entries = [(p, "spam", "add", day) for p in ("Upper.org", "slash.org/", "https://u@full.org:80//A/b/?q#f", "net", "localhost", "10.0.0.1", "[2001:DB8::1]", "0.0.1", "", "http://", "  ", "/x")]
    urls = ["http://upper.org/", "http://x.slash.org", "http://full.org/A/b/c", "http://full.org/a/b", "http://some.net", "http://localhost:80/x", "http://10.0.0.1/x", "http://11.0.0.1", "http://[2001:db8::1]:443/x", "http://[2001:db8::2]/", "http://net/", "http://upper.org/" + "p/" * 200_000]
    got = run(spark, [(k, u, day) for k, u in enumerate(urls)], entries)
    assert [got[k][3] for k in range(len(urls))] == ["upper.org", "slash.org", "full.org/A/b", None, None, "localhost", "10.0.0.1", None, "[2001:db8::1]", None, "net", "upper.org"]


def test_other_columns_and_clashing_names(spark):
    names = "id long, url string, fetched date, _row string, host int, pattern int, n int"
    df = spark.createDataFrame([(1, "http://a.org", D(2024, 1, 1), "r", 1, 2, 3)], names)
    entries = spark.createDataFrame([("a.org", "s", "add", D(2023, 1, 1), "h", 1)], ENTRIES + ", host string, until int")
    assert [tuple(r) for r in filtered(df, entries).collect()] == [(1, D(2024, 1, 1), "a.org", 1, "s", "a.org", True)]


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(9001, "http://10.0.0.1/a"), (9002, None), (9003, ""), (9004, "http://[::1]/x"), (9005, "http://A.b.example.org:8/p/q/r"), (9006, "x" * 100_000)]
    small = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").unionByName(small.select("page_id", "url")).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = op3_url_filters(spark, str(tmp_path))
    want = db.sql(OP3_SQL)
    mine = sorted((tuple(r) for r in found.select(*want.columns).collect()), key=str)
    assert mine == sorted(want.fetchall(), key=str) and len(mine) == 56
