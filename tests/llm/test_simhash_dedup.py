import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import simhash_dedup as S


def texts(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 4)):
            copy = [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in base]
            out += [" ".join(copy)] * rng.choice((1, 1, 2))
    return out


def brute(rows):
    fps = {i: S.simhash(t or "") for i, t in rows}
    bits = {i: np.unpackbits(np.frombuffer(f, np.uint8)) for i, f in fps.items() if f}
    links = {i: {j for j in bits if j != i and (bits[i] != bits[j]).sum() <= S.DISTANCE} if i in bits else set() for i, _ in rows}
    comp = {}
    for i in sorted(links):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: len(x) for i, x in links.items()}, comp


@pytest.mark.parametrize("bucket", [16384, 2])
def test_against_all_pairs(spark, bucket):
    rows = list(enumerate(texts())) + [(9001, None), (9002, ""), (9003, " \n")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = S.near_duplicates(df, bucket=bucket).collect()
    links, comp = brute(rows)
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= links[r["id"]] for r in got) and found >= 0.99 * sum(links.values())
    assert sum(r["component_id"] == comp[r["id"]] for r in got) >= 0.99 * len(rows)


def test_splitting_buckets_loses_nothing(spark):
    rows = list(enumerate(texts(30, 8)))
    df = spark.createDataFrame(rows, "id long, text string")
    a, b = (sorted(map(tuple, S.near_duplicates(df, bucket=x).collect())) for x in (16384, 3))
    assert a == b


def test_empty_table_and_stage(spark):
    assert S.near_duplicates(spark.createDataFrame([], "id long, text string")).count() == 0
    long = "alpha beta gamma " * 30_000
    rows = [(2, long, "x"), (1, long, "y"), (1, long, "y"), (None, "other words here", None), (5, None, "z"), (6, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _extra string")
    out = S.simhash_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in out.collect())) == [0, 1, 5, 6]


def test_distance_is_exact():
    a = np.frombuffer(b"".join(S.simhash(t) for t in texts(6, 3)), np.uint8).reshape(-1, 32)
    group = np.repeat([1, 2], [len(a) // 2, len(a) - len(a) // 2])
    i, j = S.close_pairs(group, np.zeros(len(a), int), np.zeros(len(a), bool), np.ascontiguousarray(a).view(np.uint64), 60)
    bits = np.unpackbits(a, axis=1)
    want = {(x, y) for x in range(len(a)) for y in range(x + 1, len(a)) if group[x] == group[y] and (bits[x] != bits[y]).sum() <= 60}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_scripts_without_breaks_between_words():
    rng = random.Random(8)
    distance = lambda a, b: int((np.unpackbits(np.frombuffer(S.simhash(a), np.uint8)) != np.unpackbits(np.frombuffer(S.simhash(b), np.uint8))).sum())
    for first, last in ((0x4E00, 0x9FFF), (0x3041, 0x3096), (0x0E01, 0x0E2E)):
        a, other = ("".join(chr(rng.randint(first, last)) for _ in range(400)) for _ in range(2))
        assert distance(a, a[:200] + other[0] + a[201:]) <= S.DISTANCE < distance(a, other)
    assert S.features("the \u65e5\u672c\u8a9e\u6587 \u4e2d end") == {"the", "\u65e5\u672c\u8a9e", "\u672c\u8a9e\u6587", "\u4e2d", "end"}
    assert S.features("na\u00efve w\u00f6rds") == {"na\u00efve", "w\u00f6rds"}


@pytest.mark.parametrize("nodes", [1000, 10**8])
def test_recall_at_every_distance(nodes):
    sampled, tables = S.parameters(nodes)
    rng = np.random.default_rng(9)
    assert (sampled > S.SAMPLED) == (nodes > S.NODES)
    for d in range(2, S.DISTANCE + 1, 8):
        a = rng.integers(0, 256, (3000, 32), np.uint8)
        flip = np.zeros((3000, 256), np.uint8)
        np.put_along_axis(flip, np.argsort(rng.random((3000, 256)), axis=1)[:, :d], 1, axis=1)
        met = (S.sampled_keys(a, sampled, tables) == S.sampled_keys(a ^ np.packbits(flip, axis=1), sampled, tables)).any(axis=1).mean()
        assert met >= 0.9, d


def test_repeated_ids_keep_their_own_links(spark):
    a, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a), (1, other), (2, a + " more"), (None, a), (7, other)]
    got = sorted((r["id"] or 0, r["n_links"], r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect())
    assert got == [(0, 0, None), (1, 1, 1), (1, 1, 1), (2, 1, 1), (7, 1, 1)]


def test_clashing_names_and_text_ids(spark):
    rows = [("b", "some words here", 5, "x", 1), ("a", "some words here", 6, "y", 2), (None, "some words here", 7, "z", 3), ("c", None, 8, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _row int, fp string, node int")
    out = S.simhash_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [rows[1], rows[3]]


def test_query_against_all_pairs(spark):
    found = S.op2_simhash_dedup(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    links, comp = brute([tuple(r) for r in docs])
    got = {r["doc_id"]: r for r in found.collect()}
    assert dict(found.dtypes) == {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert set(got) == set(links) and all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(links.values()) and all(r["n_links"] <= links[i] for i, r in got.items())
    assert sum(r["component_id"] == comp[i] for i, r in got.items()) >= 0.95 * len(got)
