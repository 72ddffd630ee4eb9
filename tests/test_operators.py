import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import assemble, knn, metrics, rank, retrieve, upsert
from loam.plans import catalogue
from loam.sources import jsonl, tables
from loam.streaming import ingest


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("blocks", [(1024, 16384), (3, 7)])
def test_top_k_by_brute_force(spark, metric, blocks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    x[7] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [float("nan")] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    got = sorted((r["qid"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(q, v, 4, metric, query_block=blocks[0], vector_block=blocks[1]).collect())
    want = []
    for i in range(0, 40, 5):
        s = np.round(knn.block_scores(x[i : i + 1].astype(float), x.astype(float), metric)[0], 6)
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-s[j], j))[:4]
        want += [(i, r + 1, j, s[j]) for r, j in enumerate(order)]
    assert got == want
    assert knn.top_k(q.limit(0), v, 4).count() == 0


def test_what_a_search_leaves_out(spark):
    v = spark.createDataFrame([(i, [1.0, n / 100]) for n, i in enumerate([2, 5, 2000, 2001, 5000])], "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS title", "vec_id AS doc_id")
    q = v.where("vec_id = 2").selectExpr("vec_id AS qid", "embedding AS qv")
    found = lambda df: {r["vec_id"] for r in df.collect()}
    assert found(knn.top_k(q, v, 9)) == {5, 2000, 2001, 5000} and found(knn.top_k(q, v, 9, leave_out=None)) == {2, 5, 2000, 2001, 5000}
    assert found(knn.top_k(q.withColumn("own", F.lit(5)), v, 9, leave_out="own")) == {2, 2000, 2001, 5000}
    variants = q.crossJoin(spark.createDataFrame([(0,), (1,)], "variant int"))
    assert found(retrieve.multi_query(variants, v, 5)) == {5, 2000, 2001, 5000}
    assert found(retrieve.multi_query(variants, v, 5, leave_out=None)) == {2, 5, 2000, 2001, 5000}


def test_a_text_is_found_under_its_own_number(spark, tmp_path):
    texts = ["apples and pears", "rivers run to the sea", "the tax on salt was raised"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    best = {r["qid"]: r["vec_id"] for r in catalogue.search_by_text(spark, str(tmp_path)).where("rank = 1").collect()}
    assert best == {0: 0, 1: 1, 2: 2}


def test_a_search_scores_whole_texts(spark, tmp_path):
    spark.createDataFrame([(7, "filler " * 300 + "walnut", "en", "s", 2106)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "filler walnut")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["rerank_score"] for r in catalogue.search_by_text(spark, str(tmp_path)).collect()] == [1.0]


def test_filters_of_a_search(spark):
    df = spark.createDataFrame([(1, "a", "hello"), (2, "b", "world"), (3, None, None)], "i int, s string, text string")
    ids = lambda **k: sorted(r["i"] for r in knn.filtered(df, **k).collect())
    assert ids(where={"s": "a"}) == [1] and ids(where={"i": {"$gt": 1}}) == [2, 3] and ids(where={"$or": [{"s": "a"}, {"i": 2}]}) == [1, 2]
    assert ids(where={"s": ["a", "b"]}, contains="wor") == [2] and ids() == [1, 2, 3]


HITS = [(1, k, k, t, s) for k, (t, s) in enumerate([("a", 0.9), ("a", 0.8), ("b", 0.7), ("a", 0.6), ("c", 0.5), ("b", 0.4)], 1)]


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(HITS, "qid long, id long, rank int, title string, score double")


def places(df, name="id"):
    return [r[name] for r in df.orderBy("qid", "rank").collect()]


def test_caps_quotas_gaps(hits):
    assert places(rank.capped(hits, "title", 2)) == [1, 2, 3, 5, 6] and places(rank.capped(hits, "title", 0)) == [1, 2, 3, 4, 5, 6]
    assert places(rank.deduplicated(hits, F.col("title"))) == [1, 3, 5]
    assert places(rank.with_quota(hits, "title", {"c": 1, "b": 1}, 4)) == [3, 5, 1, 2]
    assert rank.gaps(hits).collect()[0][1:] == (6, 0.5, 0.5556)
    assert places(rank.title_mmr(hits, 4)) == [1, 3, 5, 2]


def test_keys_of_documents(spark):
    df = spark.createDataFrame([("d", "t", "s", 1), (None, "t", None, 2), (None, None, None, 3)], "d string, t string, s string, i int")
    both = [[r[0] for r in df.select(rank.document_key(F.col("d"), F.col("t"), F.col("s"), F.col("i"), c)).collect()] for c in (False, True)]
    assert both == [["d", "t\x1f", "3"], ["d", "t\x1f", "\x1f"]]


def test_mmr_order():
    v = np.array([[1, 0], [1, 0.01], [0, 1], [0.7, 0.7]])
    sim = np.array([0.9, 0.89, 0.4, 0.8])
    assert rank.mmr_order(sim, v, 2, 0.5) == [0, 2]
    assert rank.mmr_order(sim, v, 4, 0.5) == [0, 1, 2, 3] and rank.mmr_order(sim, v, 2, 1.0) == [0, 1]


def test_same_document(spark, hits):
    h = hits.select("qid", "id", F.when(F.col("id") < 4, F.col("title")).alias("doc_id"), "rank")
    chunks = spark.createDataFrame([(1, "a", "x", 0.5), (10, "a", "본문", 0.1), (11, "a", "x", 0.9), (12, "a", "요약", None), (13, "b", "x", 0.2), (14, "z", "x", 1.0)], "id long, doc_id string, section string, score double")
    got = sorted((r["doc_id"], r["extra_rank"], r["id"]) for r in rank.expanded(h, chunks).collect())
    assert got == [("a", 1, 12), ("a", 2, 10), ("b", 1, 13)]


def test_measures(spark, hits):
    r = metrics.hit_and_rank(hits, F.col("title") == "b", 5).collect()[0]
    assert (r["hit"], r["rr"]) == (1, pytest.approx(1 / 3))
    assert metrics.hit_and_rank(hits, F.col("title") == "z", 5).collect()[0][1:] == (0, 0.0)
    n = metrics.ndcg(hits, F.col("title") == "b", F.lit(2), 6).collect()[0]["ndcg"]
    assert n == pytest.approx((1 / 2 + 1 / np.log2(7)) / (1 + 1 / np.log2(3)))
    x = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(1, 21)], "key long, a double, b double")
    assert x.agg(metrics.nearest_rank("a", 0.95)).collect()[0][0] == 19.0 and x.limit(0).agg(metrics.nearest_rank("a", 0.95), metrics.mean_or_zero("a")).collect()[0][:] == (0.0, 0.0)
    b = metrics.bootstrap(x, "a", 400).collect()[0]
    assert b["low"] < 10.5 < b["high"] and abs(b["mean"] - 10.5) < 0.5 and 3 < b["high"] - b["low"] < 8
    w = metrics.win_rate(x, "a", "b", lower_is_better=True).collect()[0]
    assert (w["n"], w["wins"], w["ties"]) == (20, 14, 6) and w["win_rate"] == pytest.approx(0.85)
    assert metrics.win_rate(x.limit(0), "a", "b").collect()[0]["win_rate"] == 0.0


def test_assembly(spark):
    rows = [("s1", "T", "본문", 0, "b0", "u2"), ("s1", "T", "본문", 1, "b1", "u1"), ("s1", "T", "본문", 2, "b0", "u1"), ("s1", "", "요약", 3, "sum", None), ("s2", None, "기타", 0, "x", None)]
    docs = {r["seed"]: r for r in assemble.assembled(spark.createDataFrame(rows, "seed string, title string, section string, pos int, chunk string, url string")).collect()}
    a = docs["s1"]
    assert a["title"] == "T" and a["section_order"] == ["요약", "본문"] and a["sections"]["본문"]["text"] == "b0\n\nb1" and a["sections"]["본문"]["urls"] == ["u1", "u2"]
    assert docs["s2"]["title"] == "s2"


def test_lines(spark):
    docs = spark.createDataFrame([(i, f"ad line\r\nown {i}\n\n  ad line ", f"s{i % 3}") for i in range(6)] + [(9, None, "s0")], "doc_id long, text string, source string")
    lines = assemble.text_lines(docs, "doc_id", "source")
    assert [tuple(r) for r in assemble.common_lines(lines, "source", 3).collect()] == [("ad line", 3, 12)]
    s = assemble.with_sections(lines, F.when(F.col("line").rlike("own"), F.col("line"))).where("doc_id = 2").orderBy("pos").collect()
    assert [(r["pos"], r["section"]) for r in s] == [(0, None), (2, "own 2")]


def test_containing(spark):
    t = spark.createDataFrame([(1, "abc def"), (2, None), (3, "abcabc")], "id long, text string")
    p = spark.createDataFrame([(1, "abc"), (2, "c d"), (3, ""), (4, "abc"), (5, None)], "phrase_id long, phrase string")
    want = [(1, 1), (1, 2), (1, 4), (3, 1), (3, 4)]
    assert sorted(map(tuple, assemble.containing(t, p).collect())) == want == sorted(map(tuple, assemble.containing(t, p, block=2).collect()))
    assert assemble.containing(t, p.limit(0)).count() == 0


def test_sections_and_targets(spark):
    df = spark.createDataFrame([("세계관 ", None), ("", "x"), (None, None), ("방영 정보", "y")], "p string, t string")
    assert [r[0] for r in df.select(assemble.section_of(F.col("p"))).collect()] == ["설정", "본문", "본문", "방영"]
    rows = [(1, 1000, 0, 0), (2, 100, 0, 0), (3, 1000, 50, 5), (4, 1000, 200, 5), (5, 0, None, None)]
    got = {r["doc_id"]: r["reason"] for r in assemble.summary_targets(spark.createDataFrame(rows, "doc_id int, body_len int, summary_len int, n_bullets int")).collect()}
    assert got == {1: "no_summary,bullets", 3: "short_summary", 5: "no_summary,bullets"}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "B", None), (4, "D", 4)], "k int, x string, y int")
    assert sorted(map(tuple, upsert.merged(old, new, ["k"], ["x", "y"]).collect())) == [(1, "a", 1), (2, "B", 2), (3, None, 3), (4, "D", 4)]
    assert sorted(map(tuple, upsert.merged(old, new, ["k"], ["x"]).collect()))[1] == (2, "B", 2)
    assert sorted((r["k"], r["x"]) for r in upsert.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, None), (4, "D")]
    rows = spark.createDataFrame([(1, 5, "old"), (1, 6, "new"), (2, 1, "x")], "k int, v int, t string")
    assert sorted(map(tuple, upsert.latest(rows, ["k"], "v").collect())) == [(1, 6, "new"), (2, 1, "x")]
    pages = spark.createDataFrame([(1,), (2,)], "doc_id int")
    chunks = spark.createDataFrame([(1, "b"), (1, "a")], "doc_id int, id string")
    state = upsert.mark_vectorized(upsert.page_state(pages, chunks, F.lit(dt.date(2024, 1, 1))), chunks, F.lit(dt.date(2024, 1, 2)))
    got = {r["doc_id"]: (r["n_segments"], r["vectorized"], r["segment_ids"]) for r in state.collect()}
    assert got == {1: (2, True, ["a", "b"]), 2: (0, False, None)}


def test_answers(spark):
    rows = [(1, r, s, "t", sec, "text") for r, s, sec in ((1, 0.9, "본문"), (2, 0.5, "요약"), (3, 0.1, "본문"))] + [(2, 1, 0.05, "t", "본문", "x")]
    df = spark.createDataFrame(rows, "qid long, rank int, score double, title string, section string, text string")
    got = {r["qid"]: r for r in retrieve.answers(df, quota={"요약": 1}, k=2).collect()}
    assert got[1]["context"].startswith("[S1] t · 요약") and got[2]["abstained"] and got[2]["context"] is None


def test_json_lines(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.jsonl").write_text('{"title": "가", "metadata": {"depth": 1}}\n\nnot json\n{"title": "b"}\n', encoding="utf-8")
    (p / "b.txt").write_text("{}")
    assert sorted(r["title"] for r in jsonl.read(spark, str(p)).collect()) == ["b", "가"]
    assert jsonl.read(spark, str(p), mode="keep").cache().where("_corrupt IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        jsonl.read(spark, str(p), mode="fail").collect()
    assert [(r["line_no"], r["title"]) for r in jsonl.read_numbered(spark, str(p)).orderBy("line_no").collect()] == [(1, "가"), (4, "b")]
    jsonl.write(jsonl.read(spark, str(p)), str(tmp_path / "out"))
    keys = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert all("content" in k for k in keys) and {k["title"] for k in keys} == {"b", "가"}
    seeds = spark.createDataFrame([("a/b:c", 1), ("d", 2)], "seed string, x int")
    jsonl.write_by_seed(seeds, str(tmp_path / "seeds"))
    assert (tmp_path / "seeds" / "file=a_b_c").exists()


def test_texts_titles_patterns(spark, tmp_path):
    for name, e in (("u.txt", "utf-8-sig"), ("k.txt", "cp949"), ("w.txt", "utf-16")):
        (tmp_path / name).write_bytes("한글 줄".encode(e))
    assert {r["text"] for r in jsonl.read_text(spark, str(tmp_path / "*.txt")).collect()} == {"한글 줄"}
    (tmp_path / "t.json").write_text('{"2024-2": ["c"], "2024-1": ["a", "b"]}')
    assert [tuple(r) for r in jsonl.read_titles(spark, str(tmp_path / "t.json")).collect()] == [("2024-1", 0, "a"), ("2024-1", 1, "b"), ("2024-2", 0, "c")]
    (tmp_path / "p.list").write_text("# note\nre:^a+$\nplain\n")
    assert [tuple(r) for r in jsonl.read_patterns(spark, str(tmp_path / "p.list")).collect()] == [("regex", "^a+$"), ("text", "plain")]


def test_collections(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, None)], "id int, text string")
    tables.write_collection(df, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 3 and tables.by_ids(back, spark.createDataFrame([(2,), (2,), (9,)], "id int")).count() == 1
    assert tables.length_statistics(back).collect()[0][:] == (2, 1, 1, 2.0, 3)


def test_stream_is_upserted_once(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    schema = "id long, ts timestamp, v string"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, "a"), (2, t, "b"), (1, t, "a")], schema).coalesce(1).write.parquet(source)
    run = lambda: ingest.ingest(ingest.once(spark.readStream.schema(schema).parquet(source), ["id", "v"], "ts"), table, mark, ["id"], "ts").awaitTermination()
    run()
    spark.createDataFrame([(2, t + dt.timedelta(minutes=5), "B"), (3, t, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    newest = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name[1:]))
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(str(newest)).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_a_tile_holds_few_scores_at_a_time(spark, monkeypatch):
    # vectors of one block, of which more are queries than are worked out at a time
    x = np.random.default_rng(5).normal(size=(300, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    q = v.selectExpr("vec_id AS qid", "embedding AS qv")
    got = {(r["qid"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(q, v, 3).collect()}
    s = np.round(knn.block_scores(x.astype(float), x.astype(float), "cosine"), 6)
    np.fill_diagonal(s, -1)
    assert got == {(i, n + 1): (j, s[i, j]) for i in range(300) for n, j in enumerate(sorted(range(300), key=lambda j: (-s[i, j], j))[:3])}
    blocks = [p for p in knn.top_k(q, v, 3)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "array<double>" in p and "cast" in p.lower()]
    assert not blocks and knn.QUERY_SLICE * knn.VECTOR_BLOCK * 8 <= 16 << 20
