"""Near-duplicate vectors by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import connected_components, discard, local_components, table, written

THRESHOLD = 0.93
#: Vectors of a block, and of the smaller tiles that a task multiplies one after the other.
BLOCK, TILE = 8192, 1024
#: Components added up in float32, in which sums of so many products of int8 are exact.
EXACT = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the quantised vector, and length of what rounding lost, a row each."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    lost = np.sqrt(((unit - near) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, np.sqrt((near**2).sum(axis=1)), lost


def int_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 values, exact: a tile's go through float32, whose product is fast and holds such sums exactly."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    out = a[:, :EXACT] @ b[:, :EXACT].T
    for k in range(EXACT, a.shape[1], EXACT):
        out = out.astype(np.float64) + a[:, k : k + EXACT] @ b[:, k : k + EXACT].T
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of x and y with cosine >= threshold in double precision; i < j where x and y are the same.

    With u = s q + e for unit vectors, u.v differs from s_u s_v q_u.q_v by at most |s_u q_u||e_v| + |e_u||s_v q_v| +
    |e_u||e_v|. Pairs that this bound keeps below the threshold are done; the others are multiplied in full.
    """
    x, y = scaled(x), scaled(y)
    norm = [np.sqrt((m * m).sum(axis=1)) for m in (x, y)]
    (qx, sx, lx, ex), (qy, sy, ly, ey) = (quantise(m / n[:, None]) for m, n in zip((x, y), norm))
    found = []
    for i in range(0, len(x), TILE):
        a = slice(i, i + TILE)
        for j in range(i if same else 0, len(y), TILE):
            b = slice(j, j + TILE)
            top = int_product(qx[a], qy[b]) * sx[a, None] * sy[None, b]
            top += lx[a, None] * ey[None, b] + ex[a, None] * (ly + ey)[None, b] + 1e-6
            at, to = np.nonzero(top >= threshold)
            at, to = at + i, to + j
            if same:
                at, to = at[at < to], to[at < to]
            for k in range(0, len(at), 1 << 16):
                p, q = at[k : k + (1 << 16)], to[k : k + (1 << 16)]
                cosine = np.einsum("ij,ij->i", x[p], y[q]) / (norm[0][p] * norm[1][q])
                found.append((p[cosine >= threshold], q[cosine >= threshold]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared if labels are equal and not null and lengths agree; null or zero vectors and such as hold null,
    NaN or infinite components link with nothing and stay by themselves, as do rows of a null vec_id. Equal vectors are one class first: a class of
    copies, however large, is one row of the tiles. Classes of a label go to blocks of about `block` rows by hash, and
    every pair of blocks is a task, so a hot label is split. A task sends back one row per class with the number of its
    links and the smallest class its links lead to, never pairs. Rows that repeat a vec_id are vectors of their own,
    linked by their own label and components, under the same id. Vectors of any length and size of components count;
    other columns, whatever their names, are left. An empty table gives an empty one.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")).alias("v"))
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where("v IS NOT NULL")
    classes = written(rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    keyed = classes.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("label", "dim", "i", "j", "own", "node", "n", "v")

    def tile(t: pa.Table) -> pa.Table:
        ids, n, own = (t.column(c).to_numpy() for c in ("node", "n", "own"))
        dim = t.column("dim")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        if len(left) and len(right):
            a, b = links(x[left], x[right], i == j, threshold)
            a, b = left[a], right[b]
        else:
            a = b = np.zeros(0, int)
        degree = (np.bincount(a, n[b], len(ids)) + np.bincount(b, n[a], len(ids))).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        root = order[local_components(len(ids), place[a], place[b])][place]
        some = np.nonzero(degree)[0]
        return pa.table({"node": ids[some], "degree": degree[some], "root": ids[root[some]]})

    found = written(sent.groupBy("label", "dim", "i", "j").applyInArrow(tile, "node long, degree long, root long"))
    degree = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("root"))
    joined = written(classes.join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(found, classes)
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    known = joined.join(least, "root").select("label", "v", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with the number of their links, the component they belong to and whether they are kept, as embedding_links has it.

    Null labels, null and zero vectors, null or non-finite components and null ids link with nothing; ties at the threshold
    link; vectors of any length and repeated rows count; other columns are left; an empty table gives no rows.
    """
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v AS MATERIALIZED (
  SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(c, vec_id) AS kept
FROM e LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
