import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import chunk, html, ids, noise, registry, text, vector


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_cleaning(spark):
    rows = [("​ ﬁne\t text\n\nｗide　",), (None,), ("",), ("\x1c a \x85",)]
    got = one(spark, rows, "t string", text.clean(F.col("t")), text.clean_plain(F.col("t")), text.strip(F.col("t")), text.search_key(F.col("t")))
    assert got[0][0] == "fine text wide" and got[1][0] == "" and got[2][0] == "" and got[0][3] == "finetextwide" and got[1][3] is None
    assert [g[2] for g in got] == [None if t is None else t.strip() for (t,) in rows]


def test_ratios_and_hosts(spark):
    rows = [("abc 가나 https://x.y www.z",), ("",), ("가나다",)]
    got = one(spark, rows, "t string", text.latin_ratio(F.col("t")), text.latin_share(F.col("t")), text.url_ratio(F.col("t")))
    assert got[1] == (1.0, 0.0, 0.0) and got[2] == (0.0, 0.0, 0.0)
    assert got[0] == pytest.approx((14 / 24, 14 / 16, 0.5))
    urls = [("HTTPS://A.b:80/c?d#e",), (None,), ("/w/%EA%B0%80+x (1기)",)]
    got = one(spark, urls, "u string", text.domain_of(F.col("u")), text.href_target(F.col("u")), text.title_of_path(F.col("u")))
    assert got[0][:2] == ("a.b:80", "HTTPS://A.b:80/c") and got[1][0] == "" and got[2][2] == "가+x"


def test_furniture_and_headlines(spark):
    lists = "\n".join(f"메뉴 {i}" for i in range(9))
    rows = [(lists,), ("본문은 아주 길게 이어지는 문장으로 이루어져 있으며 계속된다. 전화 042-123-4567 더 보기",), ("",)]
    got = [r[0] for r in one(spark, rows, "t string", text.without_furniture(F.col("t")))]
    assert got[0] == "" and "042" not in got[1] and "더 보기" not in got[1] and got[2] == ""
    got = one(spark, [("[속보] (가) 「x」\n보통 문장이다",)], "t string", text.without_headlines(F.col("t")))
    assert got == [("보통 문장이다",)]
    assert one(spark, [("글[12] 끝 [3]",)], "t string", text.without_citations(F.col("t"))) == [("글 끝",)]


def test_queries_and_aliases(spark):
    got = one(spark, [("귀칼 1기!",), ("x",)], "q string", text.query_variants(F.col("q"), {"귀칼": ["귀멸의 칼날"]}))
    assert got == [(["귀칼 1기!", "귀칼1기", "귀멸의 칼날"],), ([],)]
    got = one(spark, [("A B (가)", "A B")], "t string, s string", text.title_aliases(F.col("t"), F.col("s")))[0][0]
    assert got[0] == "A B (가)" and "AB" in got and len(set(got)) == len(got)
    assert one(spark, [("T", ["a", "b", "c"])], "t string, a array<string>", text.made_queries(F.col("t"), F.col("a"))) == [(["T", "T 요약", "T 줄거리", "T 등장인물", "a", "b"],)]
    assert one(spark, [("- a\n\n2) b\n• c",)], "t string", text.bullets(F.col("t"), 2)) == [(["a", "b"],)]


def test_fuzzy(spark):
    got = [r[0] for r in one(spark, [("abc", "xxabcxx"), ("abc", ""), ("abcd", "abzd"), (None, "a")], "a string, b string", text.fuzzy(F.col("a"), F.col("b")))]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 0.75 and got[3] is None


def test_json_repair(spark):
    bad = ['{"a": 1, "b": ["x"]}', '```json\n{"a": 1, "b": ["x",],}\n```', "{a: 1, b: [“x”]} trailing", '{"a": 1, /* no */ "b": ["x"]} // end']
    got = one(spark, [(b,) for b in bad], "t string", text.repaired_json(F.col("t"), "a int, b array<string>"))
    assert [tuple(r[0]) for r in got] == [(1, ["x"])] * 4


@pytest.mark.parametrize("line,strict,block", [
    ("평범한 한국어 문장이 여기에 있다", False, False), ("x", True, True), ("", True, True), (None, True, True), ("All Rights Reserved 모두", True, True),
    ("자세한 내용은 https://example.com 에서", True, True), ("문의 010-1234-5678 번", True, True), ("사전 등록 시작", True, False), ("특가 할부 안내", True, True), ("출장 비용 0원", True, True), ("3분 전 갱신된 글", True, True), ("plain English words only", True, False), ("속보 들어온 소식", True, True),
])
def test_noise(spark, line, strict, block):
    got = one(spark, [(line,)], "t string", noise.is_noise_line(F.col("t")), noise.is_noise_block(F.col("t")))[0]
    assert got == (strict, block)


def test_other_filters(spark):
    got = one(spark, [("설정", "등장인물", 0, "가"), ("이름", None, 2, "가"), ("가", None, 2, "가"), ("a/b", None, 3, "가"), (None, None, 1, "가")], "t string, p string, d int, s string", noise.is_no_character(F.col("t")), noise.is_character_page(F.col("t"), F.col("p"), F.col("d"), F.col("s")))
    assert [g[0] for g in got] == [True, False, False, True, True] and [bool(g[1]) for g in got] == [True, True, False, False, False]
    got = one(spark, [("한글", ""), ("abcdef", ""), ("abcdefgh가", "namu.wiki"), ("!!!", "")], "t string, d string", noise.is_low_quality(F.col("t"), F.col("d")))
    assert [g[0] for g in got] == [False, True, False, True]


def test_windows(spark):
    for n in (0, 1, 99, 100, 101, 180, 181, 400):
        t = "".join(chr(97 + i % 26) for i in range(n))
        want, i = [], 0
        while i < n:
            want.append(t[i : i + 100])
            if i + 100 >= n:
                break
            i += 80
        assert one(spark, [(t,)], "t string", chunk.windows(F.col("t"), 100, 20)) == [(want,)]


def test_packers():
    s = "가나다라마. " * 60
    packed = chunk.pack_sentences(s.strip(), 100, 200, 30)
    assert all(len(p) <= 240 for p in packed) and packed[0].startswith("가나다라마.") and packed[1][:30] in packed[0]
    assert chunk.pack_sentences("") == [] and chunk.pack_with_tail("") == []
    assert chunk.pack_with_tail("aaaa. bbbb. cccc.", 5, 12, 3) == ["aaaa. bbbb.", "bb. cccc."]
    assert chunk.stitched(["aa", "b" * 9, "c", "d"], 5) == ["aa", "b" * 9, "c d"]
    assert chunk.stitched(["aa", "bb", "cc"], 5) == ["aa bb", "cc"]
    assert chunk.merged(["aa", "bb", "c" * 10], 8, 100) == ["aa\nbb", "c" * 10]
    assert chunk.merged(["xx. yy. zz."], 1, 8) == ["xx. yy.", "zz."]


def test_context(spark):
    rows = [([("t", "s", "x" * 50), ("u", None, "y"), (None, "v", "z" * 99)],)]
    got = one(spark, rows, "i array<struct<title:string,section:string,text:string>>", chunk.context_text(F.col("i"), 20, 45))[0][0]
    assert got == "[S1] t · s\n" + "x" * 20 + "\n\n[S2] u · \ny"


def test_scores(spark):
    got = one(spark, [(0.5,), (None,), (3.0,), (-1.0,)], "d double", vector.similarity(F.col("d")), vector.similarity(F.col("d"), "l2"), vector.similarity(F.col("d"), "ip"), vector.plain_similarity(F.col("d")), vector.similarity(F.col("d"), "other"))
    assert got[0] == pytest.approx((0.75, 1 / 1.5, 1 / (1 + np.exp(-0.5)), 0.5, 0.75)) and got[1] == (None,) * 5 and got[2][0] == 0.0 and got[3][0] == 1.0
    got = one(spark, [([0.9, 0.5, 0.1],), ([0.4],), ([],)], "s array<double>", vector.confidence_minmax(F.col("s")), vector.confidence_softmax(F.col("s")))
    assert got[0][0] == pytest.approx(0.5) and got[1] == pytest.approx((0.4, 1.0)) and got[2] == (0.0, 0.0)


def test_embedders(spark):
    e = registry.embedder("fake-prefixed")
    got = one(spark, [("a",), ("a",), ("b",)], "t string", e.passages(F.col("t")), e.queries(F.col("t")))
    assert got[0] == got[1] != got[2] and got[0][0] != got[0][1] and len(got[0][0]) == e.dim == 384
    assert np.linalg.norm(got[0][0]) == pytest.approx(1, abs=1e-3)
    s = registry.summarised(F.col("t"))
    assert one(spark, [("One. Two! Three? Four.",)], "t string", s["summary"], F.size(s["bullets"])) == [("One.", 3)]


def test_html(spark):
    page = '<html><head><title>T</title><script>bad</script></head><body><nav>menu</nav><h1>등장인물</h1><div class="side ad">buy</div><div>' + "long text " * 8 + '<a href="/w/%EA%B0%80/x?y" title="가">link</a><br>tail</div><a href="/w/가/설정">s</a></body>'
    p = html.parsed(F.col("h"))
    r = spark.createDataFrame([(page,), (None,), ("<div><p>un<b>closed",)], "h string").select(p.alias("p")).select("p.*").collect()
    assert "menu" not in r[0]["text"] and "buy" not in r[0]["text"] and "bad" not in r[0]["text"]
    assert r[0]["best"].startswith("long text") and r[0]["best"].endswith("tail") and r[0]["headings"] == ["등장인물"]
    assert [x["text"] for x in r[0]["links"]] == ["link", "s"] and r[1]["text"] == "" and r[2]["text"] == "un\nclosed"
    got = one(spark, [("/w/%EA%B0%80/%EC%84%A4%EC%A0%95#x",), ("/w/가/기타",), ("/w/가",)], "h string", html.child_section(F.col("h"), F.lit("가"), ("설정", "줄거리")))
    assert got == [("설정",), (None,), (None,)]


def test_ids(spark):
    got = one(spark, [("s", "t", 3)], "a string, b string, i int", ids.block_id(F.col("a"), F.col("i")), ids.segment_id(F.col("a"), F.col("i")), ids.vector_id(F.col("a"), F.lit("등 x"), F.col("i")))
    assert got == [("s#b0003", "s:3", "s|%EB%93%B1%20x|3")]
    assert unicodedata.normalize("NFKC", "ﬁ") == one(spark, [("ﬁ",)], "t string", text.nfkc(F.col("t")))[0][0]


def test_guards_of_patterns_spare_no_match(spark):
    pieces = """namu.wiki|Powered By X engine|IMPULSADO POR y|operado por z|Hecho con a|su zona horaria es Europe/B|hCaptcha b|APPLY.|a 3분 전|010-1234-5678|www.a.b|Shop.COM|견적문의|무이자할부|전국 무료출장|더 보기|Privacy Policy|TÉRMINOS terminos|Contáctenos|"quoted words".|[단독]|단독 보도|기자|日 본문|x y z many words here.. so|and the google|편집|happy new year|QnA :|reCAPTCHA|
© a|ⓒ b|(C) c|저작권 보유|All Rights  Reserved|방영|2020.1. 2|2020년 1월 2일|Amazon Prime|HULU|YouTube|인스타그램|티빙|성우 가|감독: a|이벤트|한정판|OST|엔딩|ED 테마|♪ a|가사 b|작곡|굿즈|DVD|CD|Steam|닌텐도|HTTPS://a.b|WWW.c|이 문서의 내용 중 a|나무위키는 b|none of it|"""
    texts = [*pieces.split("|"), pieces, "net" + "www.x.y" + "flix", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for patterns in (text.FURNITURE, text.HEADLINES, text.LEFTOVERS, text.LICENSE_SPANS):
        plain = F.col("t")
        for p in patterns:
            plain = F.regexp_replace(plain, p, "")
        for r in df.select("t", text.deleted(F.col("t"), patterns).alias("a"), plain.alias("b")).collect():
            assert r["a"] == r["b"], r["t"]
    lines = df.select("t", *[(noise._may(F.col("t"), n) & F.col("t").rlike(p)).alias(f"a_{n}") for n, p in noise.FAMILIES.items()], *[F.col("t").rlike(p).alias(f"b_{n}") for n, p in noise.FAMILIES.items()]).collect()
    assert all(r[f"a_{n}"] == r[f"b_{n}"] for r in lines for n in noise.FAMILIES if r["t"] is not None)


def test_what_lines_and_windows_are_cut_from_is_worked_out_once(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    for test in (noise.is_noise_line, noise.is_noise_line_old, noise.is_noise_block):
        assert plan(test(F.col("t"))).count("btrim(") <= 1
    assert plan(chunk.labelled_windows(F.col("t"), F.lit("s"))).count("translate(") == 1
