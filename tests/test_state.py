"""State over time, and exact ranks: streams with late rows, upserts of any columns, percentiles, numbered lines."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loam.functions import html, registry, text
from loam.operators import assemble, metrics, upsert
from loam.plans import records
from loam.sources import jsonl, tables
from loam.streaming import ingest


def versions(folder):
    return sorted(p.name for p in Path(folder).iterdir() if p.name.startswith("v"))


def test_late_rows_change_nothing_newer(spark, tmp_path):
    table = str(tmp_path / "t")
    run = ingest.upsert_batch(table, ["k"], "ts")
    schema = "k int, ts int, x string"
    batches = {0: [(1, 100, "new"), (2, 1, "a")], 3: [(1, 5, "late"), (2, 2, "b"), (3, 1, "c")], 4: [(3, 0, "late")], 9: [(4, 1, "d")]}
    for number, rows in batches.items():  # numbers may have gaps
        run(spark.createDataFrame(rows, schema), number)
    want = [(1, 100, "new"), (2, 2, "b"), (3, 1, "c"), (4, 1, "d")]
    assert sorted(map(tuple, spark.read.parquet(f"{table}/v9").collect())) == want
    assert versions(table) == ["v4", "v9"]
    run(spark.createDataFrame(batches[9], schema), 9)  # run again after a failure
    assert sorted(map(tuple, spark.read.parquet(f"{table}/v9").collect())) == want
    (Path(table) / "v12").mkdir()  # a version that was never completed
    run(spark.createDataFrame([(5, 1, "e")], schema), 13)
    assert spark.read.parquet(f"{table}/v13").count() == 5


def test_rows_with_columns_without_an_order(spark):
    df = spark.sql("SELECT k, ts, map('a', k) AS m, parse_json('{\"x\": 1}') AS v, array(ts) AS a FROM VALUES (1, 1), (1, 3), (1, 2), (2, 5) AS t(k, ts)")
    assert sorted((r["k"], r["ts"], r["a"]) for r in upsert.latest(df, ["k"], "ts").select("k", "ts", "a").collect()) == [(1, 3, [3]), (2, 5, [5])]
    assert sorted((r["k"], r["ts"], r["m"]) for r in assemble.first_of(df, ["k"], ["ts"]).select("k", "ts", "m").collect()) == [(1, 1, {"a": 1}), (2, 5, {"a": 2})]
    assert upsert.orderable(df, df.columns) == ["k", "ts", "a"]


@pytest.mark.parametrize("parts", [2, 5, 256])
def test_exact_ranks(spark, parts):
    rng = random.Random(parts)
    rows = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 997), (None, 50)) for v in (rng.choice([rng.random(), 0.5, 1.0]) for _ in range(n))] + [("a", None), ("d", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in metrics.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares, parts).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        values = sorted(v for h, v in rows if h == g and v is not None)
        assert all(r[name] == values[max(math.ceil(p * len(values)), 1) - 1] for name, p in shares.items())
    assert metrics.nearest_ranks(spark.createDataFrame([], "g string, v double"), "g", "v", shares).count() == 0


def test_numbered_lines_over_blocks(spark, tmp_path):
    lines = [f'{{"k": {i}}}' if i % 4 else ("" if i % 8 else "{bad") for i in range(1, 4001)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.json").write_text('{"k": 1}\r\n\r\n{"k": 3}')
    (tmp_path / "c.txt").write_text("{}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = jsonl.read_numbered(spark, str(tmp_path), "k long").collect()
        bad = jsonl.faults(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3002 and all(r["line_no"] == r["k"] for r in rows)
    assert sorted(r["line_no"] for r in bad) == list(range(8, 4001, 8)) and {r["line"] for r in bad} == {"{bad"}


def test_strict_links(spark):
    pages = ['<div><dl><a href="/w/S/등장인물">x</a><p><a href="/w/A" title=" A ">a</a></p></dl><a href="/w/B" title="B">b</a></div>', '<a href="/w/S/등장인물">x</a><div><a href="/w/A" title="A">a</a></div>', '<div><a href="/w/A" title="A">a</a></div>', None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    assert [[tuple(x) for x in r[0]] for r in df.select(html.strict_character_links(F.col("h"))).collect()] == [[("A", "/w/A")], [], [], [], []]


def test_summaries_of_nothing(spark):
    df = spark.createDataFrame([(None, {}), (" ", {"본문": ""}), ("One. Two. Three.", {"평가": "b. c.", "가": "a."})], "t string, s map<string,string>")
    got = df.select(registry.two_bullets(F.col("t")).alias("b"), registry.document_summary(F.col("s")).alias("d")).collect()
    assert [r["b"] for r in got] == [["• 빈 입력입니다", "• 내용을 제공해 주세요"]] * 2 + [["• One.", "• Two."]]
    assert [r["d"] and r["d"]["text"] for r in got] == [None, None, "[가] a."]


def test_a_list_has_a_bound(spark):
    chunks = spark.createDataFrame([(1, "s", 0, "Some TEXT"), (1, "s", 1, "kept"), (2, "s", 0, "so text")], "doc_id int, section string, pos int, chunk string")
    listed = spark.createDataFrame([("text", "text"), ("regex", "^x")], "kind string, pattern string")
    assert [tuple(r) for r in assemble.without_listed(chunks, listed).collect()] == [(1, "s", "kept", 1)]
    with pytest.raises(ValueError):
        assemble.without_listed(chunks, listed, most=1)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert tables.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    spark_conf = {"spark.checkpoint.dir": None}

    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: spark_conf.get(key, default))

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        tables.shared_folder(Far)


def test_damaged_json_is_salvaged(spark):
    bad = ['so: {"a": 1, "b": ["x", "y {"]} and {"a": 2}', '{"a": 3, "b": ["x", "y"', '"a": 4, "b": ["x", "y"], "c": "left', "{'a': 5, 'b': ['x', 'y']}", "nothing here", None]
    rows = spark.createDataFrame([(x,) for x in bad], "t string").select(text.repaired_json(F.col("t"), "a int, b array<string>").alias("r")).collect()
    got = [r["r"] and (r["r"]["a"], r["r"]["b"]) for r in rows]
    assert got[0] == (1, ["x", "y {"]) and got[1:4] == [(3, ["x", "y"]), (4, ["x", "y"]), (5, ["x", "y"])] and not any(got[4] or ()) and not any(got[5] or ())


def test_sinks_fail_by_themselves(spark):
    seen, calls = [], []

    def full(df):
        raise OSError("full")

    out = tables.fan_out(spark.range(3), {"a": full, "b": lambda df: seen.append(df.count())})
    assert isinstance(out["a"], OSError) and out["b"] is None and seen == [3]

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    tables.retried(flaky, pause=0)
    assert len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        tables.retried(lambda: 1 / 0, 2, 0)


def test_a_summary_cut_behind_its_section_keeps_the_line_ends(spark):
    # 280 signs end within what parts two sections; of these only blanks are trimmed
    df = spark.createDataFrame([(1, "x" * 273), (2, "x" * 272 + " ")], "i int, t string")
    s = F.create_map(F.lit("본문"), F.col("t"), F.lit("설정"), F.lit("y."))
    got = [r["d"]["text"] for r in df.select("i", registry.document_summary(s).alias("d")).orderBy("i").collect()]
    assert got == ["[본문] " + "x" * 273 + "\n\n", "[본문] " + "x" * 272 + " \n\n"]


def test_the_cuts_of_percentiles_are_worked_out_once(spark):
    # a sketch worked out twice may cut twice in different places, and then ranks are counted in other ranges than rows are sorted in
    rows = spark.range(2000).selectExpr("concat('g', id % 2) AS g", "double(id) AS v").repartition(7)
    plan = metrics.nearest_ranks(rows, "g", "v", {"p50": 0.5})._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan.lower()


def test_batches_are_limited_once(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    try:
        for before, after in (("10000", 500), ("0", 500), ("100", 100)):
            spark.conf.set(key, before)
            assert tables.table(spark, str(tmp_path), "t").count() == 3
            assert int(spark.conf.get(key)) == after and tables.ARROW_BYTES == 4 << 20
    finally:
        spark.conf.set(key, was)


def test_more_encoded_texts_make_more_files(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "files")
    monkeypatch.setattr(tables, "shared_folder", lambda _: where)
    spark.range(5600).selectExpr("id AS doc_id", "concat('텍스트 ', id) AS text", "'ko' AS lang", "'s' AS source", "9L AS n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert records.encoded_texts(spark, str(tmp_path)).distinct().count() == 5600
    assert max(len(p.read_bytes().decode("utf-16" if p.read_bytes()[:2] in (b"\xfe\xff", b"\xff\xfe") else "utf-8").splitlines()) for p in Path(where).glob("*.json")) <= 500


def test_one_sorted_file_of_many_parts(spark, tmp_path):
    where = str(tmp_path / "one")
    rows = spark.range(5000).repartition(7).orderBy("id").selectExpr("CASE WHEN id % 3 = 1 THEN '  ' ELSE CAST(id AS STRING) END AS value")
    tables.write_one_text(rows, where)
    files = list(Path(where).glob("*.txt"))
    assert len(files) == 1 and files[0].read_text().split("\n") == [*("  " if i % 3 == 1 else str(i) for i in range(5000)), ""]
    tables.write_one_text(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert jsonl.numbered_lines(spark, str(tmp_path / "none"), "*.txt").count() == 0


def test_numbered_orders_are_not_sorted_by_one_task(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(tables, "write_one_text", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df.write.text(a[0])))
    records.jsonl_numbered(spark, "/root/testdata/sf0.001")
    assert plans and "Repartition" not in plans[0]
