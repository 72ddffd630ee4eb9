"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import checkpointed, table

#: numpy's own generator refuses populations beyond this.
NUMPY_LIMIT = 10**9


def rise(x: float, d: float) -> float:
    """lgamma(x + d) - lgamma(x), for large x without the loss that the difference of two large numbers brings."""
    if min(x, x + d) < 1e6:
        return math.lgamma(x + d) - math.lgamma(x)
    return d * math.log(x) + (x + d - 0.5) * math.log1p(d / x) - d + (1 / (x + d) - 1 / x) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` drawn without return. Past numpy's limit by ratio of uniforms, with
    probabilities relative to the mode's that are good to about 1e-8."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad
    mean = draws * good / n
    sd = math.sqrt(max(mean * bad / n * (n - draws) / (n - 1), 1e-12) + 0.5)
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max(int((draws + 1) * (good + 1) / (n + 2)), low), high)

    def log_p(k: int) -> float:
        d = k - mode
        return -(rise(mode + 1, d) + rise(good - mode + 1, -d) + rise(draws - mode + 1, -d) + rise(bad - draws + mode + 1, d))

    width = 1.7155277699214135 * sd + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / max(u, 1e-300))
        if low <= k <= high and 2 * math.log(max(u, 1e-300)) <= log_p(k):
            return k


def draw_counts(rng: np.random.Generator, columns: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` rows, taken without return, fall to each column, of which there are columns[j] places."""
    out, rest = np.zeros_like(columns), int(columns.sum())
    for j, c in enumerate(columns.tolist()):
        if draws == 0:
            break
        out[j] = k = hypergeometric(rng, c, rest - c, draws)
        draws, rest = draws - k, rest - c
    return out


def matrix_row(part: int, sizes: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row `part` of the matrix whose row sums are `sizes` and column sums `columns`, law of a uniform permutation.

    Every caller descends the same binary tree over partitions with the same seeds, so all rows agree and no one holds
    the whole matrix: time and memory are those of log2(partitions) rows.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high, node = 0, len(sizes), 1
    while high - low > 1:
        middle = (low + high) // 2
        left = draw_counts(np.random.default_rng([seed, 1, node]), columns, int(before[middle] - before[low]))
        if part < middle:
            high, columns, node = middle, left, 2 * node
        else:
            low, columns, node = middle, columns - left, 2 * node + 1
    return columns


def hypergeometric_shards(df: DataFrame, n_shards: int, *, seed: int = 20240611, rows_per_block: int = 1 << 20) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard), a uniform random permutation.

    Shards hold N // n_shards rows, the first N % n_shards of them one more. A shard is made of blocks of at most
    rows_per_block places, and these are the columns of the communication matrix, so that no task holds more than a
    block. Each partition permutes its rows, sends matrix[partition, block] of them to every block, and each block
    permutes what it got. Columns named shard or slot in df are replaced. Repeated rows, ties and nulls are rows like
    any other; an empty table gives an empty one; with fewer rows than shards some shards stay empty. df is
    checkpointed first: pass the columns that the exchange should carry, not the texts.
    """
    spark = df.sparkSession
    df = checkpointed(df.drop("shard", "slot"))
    found = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], dtype=np.int64)  # 8 bytes a partition
    n = int(sizes.sum())
    shard_of, base, columns = [], [], []
    for s in range(n_shards):
        rows = n // n_shards + (s < n % n_shards)
        blocks = -(-rows // rows_per_block)
        edges = [rows * b // max(blocks, 1) for b in range(blocks + 1)]
        for a, b in zip(edges, edges[1:]):
            shard_of.append(s)
            base.append(a)
            columns.append(b - a)
    shard_of, base, columns = (np.array(x, dtype=np.int64) for x in (shard_of, base, columns))
    names = ["_block", "_shard", "_base", "_key", "_at"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, order = TaskContext.get().partitionId(), 0, None
        rng = np.random.default_rng([seed, 2, part])
        for batch in batches:
            if order is None:
                order = rng.permutation(np.repeat(np.arange(len(columns)), matrix_row(part, sizes, columns, seed)))
            block = order[at : at + batch.num_rows]
            extra = [block, shard_of[block], base[block], rng.integers(-(1 << 63), 1 << 63, len(block), dtype=np.int64), (part << 33) + at + np.arange(len(block))]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=[*batch.schema.names, *names])

    # payload columns travel in one struct, so their names can't clash with ours
    boxed = df.select(F.struct("*").alias("_row"))
    schema = T.StructType([*boxed.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    sent = boxed.mapInArrow(assign, schema)
    place = Window.partitionBy("_block").orderBy("_key", "_at")
    return sent.withColumn("_rank", F.row_number().over(place)).select("_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_base") + F.col("_rank") - 1).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    A null or empty text has size 16 and crc32 0; long texts count whole, though only their size and sum are shuffled;
    repeated rows, equal sums, and null or equal ids are rows like any other; other columns are left; an empty table gives
    no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"))
    out = hypergeometric_shards(docs.select("doc_id", (F.col("_bytes") + 16).alias("size"), "text_crc32"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
