"""The pipeline on a small folder against a plain version of each of its stages."""

import numpy as np
import pytest

import corpus_pipeline
from loam.llm._shared import written
from loam.llm.quality import fitted
from loam.llm.simhash_dedup import DISTANCE, simhash

from .test_suffix_dedup import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR)))
    return out


def test_classifier(spark, steps):
    model = fitted(steps[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    want = {r["doc_id"] for r in steps[0].collect() if model.score(r["text"] or "") >= 0.5}
    assert {r["doc_id"] for r in steps[1].collect()} == want


def test_one_of_each_group_stays(steps):
    rows = [(r["doc_id"], simhash(r["text"] or "")) for r in steps[1].collect()]
    bits = {i: np.unpackbits(np.frombuffer(f, np.uint8)) for i, f in rows if f}
    comp = {i: i for i, _ in rows}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in bits:
        for j in bits:
            if i < j and (bits[i] != bits[j]).sum() <= DISTANCE:
                a, b = sorted((top(i), top(j)))
                comp[b] = a
    assert {r["doc_id"] for r in steps[2].collect()} == {i for i in comp if comp[i] == i}


def test_passages_go(steps):
    rows = [(r["doc_id"], r["doc_id"], r["text"]) for r in steps[2].collect()]
    found = {r: (n, m) for r, n, m, *_ in brute(rows)}
    got = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    assert set(got) == {i for i, (n, m) in found.items() if m < n or n == 0}
    for i, _, t in rows:
        if i in got:
            assert len((t or "").encode()) - found[i][1] - 8 * found[i][0] / 50 <= len(got[i].encode()) <= len((t or "").encode()) - found[i][1]
            assert found[i][1] or got[i] == t


def test_copies_and_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    before, after = steps[3].collect(), steps[4].collect()
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert abs(words(after) / words(before) - 1.5) < 0.1


def test_packing(steps):
    docs = {}
    for r in steps[4].collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    rows = steps[5].collect()
    once = [(i, t[0]) for i, t in docs.items() if len(t) == 1]
    only = [r for r in rows if r["doc_id"] in dict(once)]
    assert sum(r["length"] for r in only) == sum(max(x["doc_tokens"] for x in only if x["doc_id"] == i) for i, _ in once)
    per = {}
    for r in rows:
        per[r["sequence_id"]] = per.get(r["sequence_id"], 0) + r["length"]
    assert max(per.values()) <= 2048


def test_run_gives_the_same(spark, steps):
    a = sorted(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "start", "length", "ids_crc32").collect()), key=str)
    assert a == sorted(map(tuple, steps[5].select("doc_id", "start", "length", "ids_crc32").collect()), key=str)


@pytest.mark.parametrize("rows", [0, 60])
def test_empty_tables_and_clashing_names(spark, tmp_path, rows):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").limit(rows)
    extra = "'r' AS _row, 1 AS _doc, 'f' AS fp, 2 AS node, 3 AS row, 4 AS size, 5 AS copies, 6 AS _score, 'x' AS shard"
    both = docs.selectExpr("*", *extra.split(", "))
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0), (8, "word " * 100_000, None, "s", 500_000)], docs.schema).limit(4 if rows else 0)
    both = both.unionByName(odd.selectExpr("*", *extra.split(", ")))
    both.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").limit(rows).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = out.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, out, str(tmp_path)))
        assert out.columns == names, name
    got = out.collect()
    assert all((r["_row"], r["_doc"], r["fp"], r["node"], r["row"], r["size"], r["copies"], r["_score"], r["shard"]) == ("r", 1, "f", 2, 3, 4, 5, 6, "x") for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
    assert (packed.count() > 0) == (rows > 0) == (len(got) > 0)
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (rows > 0)
