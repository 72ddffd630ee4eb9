"""Exact nearest neighbours of a stated query set, by products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a block; every pair of blocks is a task.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 16384
#: Queries and vectors of a block whose scores are worked out at a time, so that a task holds little beside its blocks.
QUERY_SLICE, VECTOR_SLICE = 64, 2048


def filtered(df: DataFrame, where: dict | None = None, contains: str | None = None, text: str = "text") -> DataFrame:
    """Rows whose columns equal the values given (a list: are among them; {"$gt": x} and the like: compare so) and whose text holds a string."""
    compare = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v)}

    def column(rule: dict) -> Column:
        out = F.lit(True)
        for k, v in rule.items():
            if k in ("$and", "$or"):
                parts = [column(x) for x in v]
                joined = parts[0]
                for p in parts[1:]:
                    joined = joined & p if k == "$and" else joined | p
                out = out & joined
            elif isinstance(v, dict):
                for op, x in v.items():
                    out = out & compare[op](F.col(k), x)
            else:
                out = out & (F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v)
        return out

    if where:
        df = df.where(column(where))
    return df.where(F.contains(text, F.lit(contains))) if contains else df


def block_scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Score of all pairs in [0, 1]: 1 - d/2 for cosine distance d, 1 / (1 + d) for squared L2, the logistic of a dot product."""
    if metric == "cosine":
        n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        s = 1 - (1 - np.divide(q @ v.T, n, out=np.zeros((len(q), len(v))), where=n > 0)) / 2
    elif metric == "l2":
        d = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0)
        s = 1 / (1 + d)
    else:
        s = 1 / (1 + np.exp(-(q @ v.T)))
    return np.clip(s, 0, 1)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", digits: int = 6, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, leave_out: str | None = "qid", variant: str | None = None) -> DataFrame:
    """(qid, vec_id, rank, score): for each query (qid, qv) the k best vectors (vec_id, embedding) but its own.

    Its own is the one whose vec_id is the query's value of the column `leave_out`; None, for queries that aren't among
    the vectors, leaves out none. With `variant`, the name of a column, each pair of qid and that is a query of its own, and
    the result has the column too.

    Ranked by score rounded to `digits`, then vec_id. Queries and vectors go to blocks by hash of the id, their numbers
    from the counts; a pair of blocks is one task that sends back k rows a query, so what is shuffled after the products
    is queries * blocks * k rows. Floats stay floats until they are multiplied. Null vectors and such with null or non-finite components are left out.
    """
    fine = lambda c: c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    numbers = lambda df, c: F.col(c) if df.schema[c].dataType.simpleString() == "array<float>" else F.col(c).cast("array<double>")
    q = queries.where(fine(F.col("qv"))).select(F.col("qid"), numbers(queries, "qv").alias("v"), *([F.col(leave_out).alias("own")] if leave_out else []), (F.col(variant).cast("long") if variant else F.lit(0).cast("long")).alias("w"))
    v = vectors.where(fine(F.col("embedding"))).select("vec_id", numbers(vectors, "embedding").alias("v"))
    n = q.agg(F.count(F.lit(1)).alias("n")).unionByName(v.agg(F.count(F.lit(1)).alias("n")))
    a, b = (max(1, -(-r["n"] // size)) for r, size in zip(n.collect(), (query_block, vector_block)))
    q = q.withColumn("i", F.pmod(F.xxhash64("qid"), F.lit(a)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    v = v.withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(b)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            of = left.column("w").to_numpy()
            qid, vid = left.column("qid").to_numpy(), right.column("vec_id").to_numpy()
            x, y = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
            own = left.column("own").to_numpy() if leave_out else None
            for a in range(0, len(x), QUERY_SLICE):
                some_x = x[a : a + QUERY_SLICE].astype(np.float64)
                s = np.empty((len(some_x), len(y)))
                for b in range(0, len(y), VECTOR_SLICE):
                    s[:, b : b + VECTOR_SLICE] = np.round(block_scores(some_x, y[b : b + VECTOR_SLICE].astype(np.float64), metric), digits)
                if own is not None:
                    s[own[a : a + QUERY_SLICE][:, None] == vid[None, :]] = -1
                for i, row in enumerate(s):
                    some = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                    best = some[np.lexsort((vid[some], -row[some]))][:k]
                    best = best[row[best] >= 0]
                    for held, more in zip(out, (np.full(len(best), qid[a + i]), np.full(len(best), of[a + i]), vid[best], row[best])):
                        held.append(more)
        return pa.table(dict(zip(("qid", "w", "vec_id", "score"), map(np.concatenate, out))))

    found = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(tile, "qid long, w long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid", "w").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumnRenamed("w", variant) if variant else best.drop("w")


def search(queries: DataFrame, vectors: DataFrame, n: int = 8, where: dict | None = None, **options) -> DataFrame:
    """top_k behind a filter. n is kept between 1 and 100, as a search service would: ask top_k for more."""
    return top_k(queries, filtered(vectors, where), min(max(n, 1), 100), **options)


#: Kinds of index by name: the measure that each ranks by.
BACKENDS = {"collection": "cosine", "flat": "l2", "products": "ip"}


def search_in(backend: str, queries: DataFrame, vectors: DataFrame, n: int = 8, where: dict | None = None, **options) -> DataFrame:
    """search by the measure of a backend; one that isn't known falls back on the first."""
    return search(queries, vectors, n, where, metric=BACKENDS.get(backend, next(iter(BACKENDS.values()))), **options)
