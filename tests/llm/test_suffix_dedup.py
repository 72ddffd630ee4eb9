import hashlib
import random

import duckdb
import numpy as np
import pytest

from loam.llm import suffix_dedup as S
from loam.llm.suffix_dedup import removed_passages, suffix_stage, whole_characters

SCHEMA = "row long, doc long, text string"


def made(seed=3, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(6, 40))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        out.append(" ".join(parts))
    return out + [out[3], out[3], "ab" * 400, "ab" * 300, "z" * 49, "z" * 49, "z" * 50, "y" * 50, "y" * 51, "", shared[0][:60] * 2, shared[0]]


def brute(rows):
    last = (1 << 63) - 1
    data = [(r, last if d is None else d, (t or "").encode()) for r, d, t in rows]
    least = {}
    for _, d, b in data:
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], last))
    out = []
    for r, d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((r, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,chunk,part", [(20_000, 8_000_000, 1 << 20), (1, 700, 64), (2, 2500, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, hot, chunk, part):
    monkeypatch.setattr(S, "SORTED", part)
    rows = [(k, k * 7 % 89, t) for k, t in enumerate(made())] + [(900, None, made()[5]), (901, None, made()[5]), (902, 4, None), (903, 4, made()[9]), (903, 4, made()[9])]
    got = removed_passages(spark.createDataFrame(rows, SCHEMA), hot=hot, chunk_bytes=chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, 1, long), (2, 2, "x" + long[100_000:100_200] + "y")]
    got = {r["row"]: r["n_removed"] for r in removed_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 200}
    assert removed_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cover_holds_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
    lengths = np.array([0, 49, 50, 51, 80, 200, 3])
    begin = np.cumsum(lengths) - lengths
    doc, place = S.cover_sample(begin, lengths)
    want = [(d, b + p) for d, (b, n) in enumerate(zip(begin, lengths)) if n >= 50 for p in range(n - 19) if p % 31 in S.COVER]
    assert list(zip(doc.tolist(), place.tolist())) == want
    # any two passages have sampled grams at one distance
    places = {d: {p - begin[d] for e, p in want if e == d} for d in range(len(lengths))}
    for i in range(31):
        for j in range(200 - 49):
            assert any(i + d in places[4] and j + d in places[5] for d in range(31))


@pytest.mark.parametrize("few", [0, 3, 128])
def test_pairs_and_order_agree_with_all_comparisons(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "SORTED", 31 * 7)
    rng = random.Random(few)
    rows = []
    for _ in range(120):
        gram = rng.choice([b"g" * 20, b"h" * 20])
        left, right = (bytes(rng.choice(b"ab") if rng.random() < 0.03 else 97 for _ in range(rng.randint(15, 30))) for _ in range(2))
        rows.append((rng.choice([1, 1, 2]), rng.randint(0, 9), left, gram, right))
    n = np.array([len(x) + len(y) - 29 for _, _, x, _, y in rows])
    text = [x + gram + y for _, _, x, gram, y in rows]
    size = np.array([len(t) for t in text])
    got = S.repeated(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), n, np.array([len(r[2]) for r in rows]), np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size)
    seen = [(r[0], r[1], len(r[2]) - k, t[k : k + 50]) for r, t, m in zip(rows, text, n) for k in range(m)]
    want = [any(s[0] == r[0] and s[1] < r[1] and s[2:] == (len(r[2]) - k, t[k : k + 50]) for s in seen) for r, t, m in zip(rows, text, n) for k in range(m)]
    assert [bool(x >> k & 1) for x, m in zip(got.tolist(), n) for k in range(m)] == want
    assert any(want) and not all(want)


def test_only_whole_characters_stay():
    text = "aéé".encode()
    for gone, left in (([0, 1, 1, 0, 0], "aé"), ([0, 1, 0, 0, 0], "aé"), ([1, 0, 0, 0, 1], "é"), ([0] * 5, "aéé")):
        assert whole_characters(text, np.array(gone, bool)).decode() == left


def test_stage(spark):
    rows = [(k, t, "s", len(t), k % 2) for k, t in enumerate(made())] + [(800, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_chars long, n_removed int")
    out = suffix_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    want = {r: m for r, n, m, *_ in brute([(r[0], r[0], r[1]) for r in rows])}
    gone = {r for r, n, m, *_ in brute([(r[0], r[0], r[1]) for r in rows]) if n and n == m}
    assert set(got) == {r[0] for r in rows} - gone and got[800] is None
    assert all(got[r[0]] == r[1] for r in rows if r[0] in got and want[r[0]] == 0)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def test_query_against_brute_force(spark):
    found = S.op8_suffix_dedup(spark, "/root/testdata/sf0.001")
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert sorted(map(tuple, found.collect()), key=str) == brute([(i, i, t) for i, t in docs])


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(k * 7 % 89, t) for k, t in enumerate(made())] + [(900, None), (901, ""), (902, "\u00e9" * 24 + "xx"), (903, "\u00e9" * 24 + "xx")]
    spark.createDataFrame([(*r, "r", 1, "h") for r in rows], "doc_id long, text string, row string, chunk int, h string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.sql(S.OP8_SQL)
    found = S.op8_suffix_dedup(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)
