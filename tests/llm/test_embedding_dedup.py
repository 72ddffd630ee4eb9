import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.embedding_dedup import OP5_SQL, embedding_links, int_product, op5_embedding_dedup, quantise

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(n=240, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.28])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3)) if rng.random() > 0.05 else None))
    bad = [None, [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], []]
    return rows + [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(2000, [None, 1.0], 1)]


def brute(rows, threshold=0.93):
    good = {i: (np.array(v, float), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _, _ in rows}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and x == y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    comp = {}
    for i in sorted(links):
        todo = [i] if i not in comp else []
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += links[k]
    return {i: (len(x), comp[i], comp[i] == i) for i, x in links.items()}


@pytest.mark.parametrize("block", [8192, 16])
def test_against_all_pairs(spark, block):
    rows = made()
    got = embedding_links(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute(rows)


def test_empty_and_repeated(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 1)] * 3 + [(2, [2.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n string")
    got = sorted(map(tuple, embedding_links(df).collect()), key=str)
    assert got == sorted([(1, 3, 1, True)] * 3 + [(2, 3, 1, False), (None, 0, None, True)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.floats(0.001, 50))
def test_bound_holds(seed, dim, spread):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(8, dim)) * np.exp(rng.normal(size=(8, dim)) * min(spread, 5))
    u = x / np.sqrt((x * x).sum(1))[:, None]
    q, s, near, lost = quantise(u)
    top = int_product(q, q) * s[:, None] * s[None, :] + near[:, None] * lost[None, :] + lost[:, None] * (near + lost)[None, :] + 1e-6
    assert (u @ u.T <= top).all()


def test_repeated_ids_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.1], 2), (1, [0.0, 1.0], 2), (2, [1.0, 0.01], 1), (3, [0.9, 0.0], 1), (4, [0.1, 1.0], 2)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_links(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1)]


def test_components_of_any_size(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [2e-200, 0.0], 1), (3, [1e200, 1e190], 1), (4, [5e-324, 0.0], 1), (5, [0.0, 1e300], 1), (6, [1.0] * 3000, 2), (7, [2.0] * 3000, 2)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_query_against_all_pairs(spark):
    found = op5_embedding_dedup(spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert dict(found.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()} == brute(rows)


def test_query_agrees_with_its_sql(spark, tmp_path):
    spark.createDataFrame(made(), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = db.sql(OP5_SQL)
    found = op5_embedding_dedup(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)
