import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm.sharding import draw_counts, hypergeometric, hypergeometric_shards, matrix_row, op1_sharding, rise


@pytest.mark.parametrize("n,shards,block", [(103, 7, 1 << 20), (103, 7, 5), (3, 7, 10), (0, 4, 10)])
def test_sizes_are_exact_and_slots_gapless(spark, n, shards, block):
    df = spark.range(n).repartition(3).withColumn("shard", F.lit("old"))  # a clashing name is replaced
    rows = hypergeometric_shards(df, shards, rows_per_block=block).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(n // shards + (s < n % shards)))


def test_rows_of_the_matrix_add_up():
    sizes, columns = np.array([5, 0, 9, 6]), np.array([7, 7, 6])
    rows = [matrix_row(p, sizes, columns, 3) for p in range(4)]
    assert [r.sum() for r in rows] == sizes.tolist()
    assert (sum(rows) == columns).all()


def test_every_place_is_as_likely():
    rng = np.random.default_rng(1)
    drawn = np.array([draw_counts(rng, np.array([4, 4, 2]), 5) for _ in range(4000)])
    assert np.abs(drawn.mean(0) - [2, 2, 1]).max() < 0.05


def test_beyond_the_library_limit():
    rng = np.random.default_rng(2)
    x = np.array([hypergeometric(rng, 10**9, 3 * 10**9, 10**6) for _ in range(400)])
    sd = (10**6 * 0.25 * 0.75) ** 0.5
    assert abs(x.mean() - 250_000) < 4 * sd / 20 and 0.8 < x.std() / sd < 1.2


def test_repeated_rows_nulls_and_long_texts(spark):
    rows = [(None, None), (1, "x"), (1, "x"), (2, "y" * 200_000)]
    out = hypergeometric_shards(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(map(str, rows))


def test_differences_of_log_gamma():
    for x, d in ((2e6, 5.0), (1e6, -3.0), (3e9, 12345.0), (7e5, 4e5)):
        exact = sum(math.log(x + k) for k in range(int(d))) if d > 0 else -sum(math.log(x - k) for k in range(1, int(-d) + 1))
        assert abs(rise(x, d) - exact) < 1e-12 * abs(exact) + 1e-8


def test_large_populations_have_the_law_of_small_ones():
    """Few draws from very many are binomial to the last digit that a test can see."""
    rng = np.random.default_rng(5)
    x = Counter(hypergeometric(rng, 3 * 10**9, 9 * 10**9, 12) for _ in range(4000))
    want = [math.comb(12, k) * 0.25**k * 0.75 ** (12 - k) * 4000 for k in range(13)]
    assert sum((x[k] - w) ** 2 / w for k, w in enumerate(want) if w > 5) < 30


def test_a_shuffle_is_uniform(spark):
    """Over seeds every row comes to every shard and slot equally often, and pairs share a shard as often as they should."""
    df = spark.range(6).repartition(2).cache()
    place, together = Counter(), 0
    for seed in range(60):
        at = {r["id"]: (r["shard"], r["slot"]) for r in hypergeometric_shards(df, 2, seed=seed, rows_per_block=2).collect()}
        place.update((i, s) for i, s in at.items())
        together += sum(at[i][0] == at[j][0] for i in range(6) for j in range(i))
    assert all(1 <= place[i, (s, k)] <= 24 for i in range(6) for s in range(2) for k in range(3))
    assert abs(together / 60 - 15 * 0.4) < 1e-9


def test_query_against_the_texts(spark):
    found = op1_sharding(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = found.collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in docs.items()}
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, op1_sharding(spark, "/root/testdata/sf0.001").collect()), key=str)
