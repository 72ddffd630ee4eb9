import json

from pyspark.sql import functions as F

from loam.operators import project as P


def records(spark, *rows):
    return spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "j string").select(F.parse_json("j").alias("v"))


def test_pickers(spark):
    df = records(spark, {"summary": " s ", "bullets": ["a", 1, " b ", ""]}, {"summary": {"x": 1}, "sections": {"본문": {"text": "body"}}, "sum_bullets": list("abcdefg")}, {"sections": {"요약": "plain"}}, {})
    got = [tuple(r) for r in df.select(P.summary_of(F.col("v")), P.bullets_of(F.col("v"))).collect()]
    assert got == [("s", ["a", "b"]), ("body", list("abcde")), ("plain", None), (None, None)]


def test_characters(spark):
    df = records(spark, {"characters": [{"name": " n ", "desc": "d", "url": "u", "none": None}, {"이름": "k"}, {"desc": "nameless"}]}, {})
    got = [[(c["name"], c["summary"], json.loads(c["meta"])) for c in r[0]] for r in df.select(P.characters_of(F.col("v"))).collect()]
    assert got[0][0][:2] == ("n", "d") and got[0][0][2]["url"] == "u" and got[0][1] == ("k", "", {}) and len(got[0]) == 2 and got[1] == []


def test_metadata(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, "", 5), (2, 1, None, None)], "k int, o int, s string, n int")
    assert sorted(map(tuple, P.merged_metadata(df, "k", "o").collect())) == [(1, "b", 5), (2, None, None)]
    m = spark.createDataFrame([({"a": "x", "b": None},)], "m map<string,string>")
    assert m.select(P.without_nulls(F.col("m"))).collect()[0][0] == {"a": "x"}
    u = spark.createDataFrame([("", ["s"], ["b"]), (None, [], ["b"]), ("u", None, None), (None, None, None)], "u string, s array<string>, b array<string>")
    assert [r[0] for r in u.select(P.source_url(F.col("u"), F.col("s"), F.col("b"))).collect()] == ["s", "b", "u", None]
    s = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "doc_id int, section string")
    assert P.sections_present(s).collect()[0][1] == "a,b"


def test_subpages(spark):
    rows = [("s", "D", "s", None, 0, "x", False), ("s", "D", "D", None, 1, "x", False), ("s", "D", "등장인물", None, 1, "x", None), ("s", "D", "이름", "등장인물", 2, "x", False), ("s", "D", "평가", None, 1, "x", False), ("s", "D", "목록", None, 1, "x", True), ("s", "D", "빈", None, 1, " ", False)]
    df = spark.createDataFrame(rows, "seed string, doc_title string, title string, parent string, depth int, text string, has_list boolean")
    got = sorted((r["title"], r["bucket"], r["is_character"]) for r in P.subpages(df).collect())
    assert got == sorted([("등장인물(허브)", "hub", False), ("이름", "character", True), ("평가", "other", False), ("목록", "character_list", False)])
