"""Helpers common to the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows per Arrow batch; texts can be long, so it is kept well under Spark's default.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Where the session allows larger Arrow batches, they are limited to ARROW_ROWS rows from
    here on, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset one of our own, which only a local master may have."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loam-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: Folders that written() made and nobody deleted yet, with their sessions.
_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that written() returned and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_loam_folder", None)
        if path and (spark := _made.pop(path, None)):
            _delete(spark, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list that at the end holds the folders that written() made within and that are still there."""
    before, made = set(_made), []
    try:
        yield made
    finally:
        made += [p for p in _made if p not in before]


def discard_folders(paths: list[str], read: DataFrame | None = None) -> None:
    """Delete folders that written() made, but for those that `read` reads from."""
    files = read.inputFiles() if read is not None and paths else []
    for path in paths:
        if path in _made and not any(f"{path.rsplit('/', 1)[-1]}/" in f for f in files):
            _delete(_made.pop(path), path)


@atexit.register
def _delete_all() -> None:
    """What results were still to be read from when the program ended."""
    for path in list(_made):
        try:
            _delete(_made.pop(path), path)
        except Exception:  # the session has stopped
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder and read again: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loam-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._loam_folder = path
    return found


def boxed(docs: DataFrame) -> DataFrame:
    """docs written as _doc, a struct of its columns whose names so can't clash with ours, and _row, a number of its own a row."""
    return written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; the partition layout is then fixed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a column `name`: the row's place from 0 among the rows of its `group` value (null is a group) by `order`.

    No group is held by one task: rows are range-sorted by (group, order), numbered inside each range, and each
    (range, group) gets the number of rows of that group in earlier ranges. Only those counts, at most ranges + groups
    rows, pass through a window.
    """
    g, mid = F.col(group), F.col("_mid")
    keys = [g.asc_nulls_first(), *order]
    numbered = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_pid", F.shiftright(mid, 33))
    parts = numbered.groupBy("_pid", g.alias("_g")).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed("_pid", "_p")
    joined = numbered.join(parts, (numbered["_pid"] == parts["_p"]) & g.eqNullSafe(parts["_g"]))
    return joined.withColumn(name, F.col("_before") + mid - F.col("_first")).drop("_mid", "_pid", "_p", "_g", "_first", "_n", "_before")


def running(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """df with, for each of the columns, `_before_<column>`: its sum over the rows before in `order`, which must tell rows apart.

    Rows are range-sorted and summed within ranges; only a row a range passes through one task.
    """
    mid, pid = F.col("_mid"), F.shiftright("_mid", 33).alias("_pid")
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    rows_ = rows.withColumn("_pid", pid)
    ranges = rows_.groupBy("_pid").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_pid", *[F.coalesce(F.sum(f"_s_{c}").over(upto), F.lit(0)).alias(f"_s_{c}") for c in columns])
    within = Window.partitionBy("_pid").orderBy(mid).rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_s_{c}")).alias(f"_before_{c}") for c in columns]
    return rows_.join(ranges, "_pid").select(*df.columns, *sums)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links (a[i], b[i]) lead to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def connected_components(edges: DataFrame, seed: int = 1) -> DataFrame:
    """(id, component) of all ends of edges (a, b): component is the smallest id that links lead to.

    Randomised contraction: in every round each node joins the neighbour (or itself) of least hash under a new seed, and
    edges move to the nodes joined; that leaves about half of them whatever the shape of the graph. Rounds are written,
    so lost executors cost no more than a round. Loops and repeated edges do no harm; no edges give no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select("a", "b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        salt = F.lit(seed + len(maps))
        best = F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("v")))
        joined = e.groupBy(F.col("a").alias("id")).agg(best.alias("m"))
        own = F.struct(F.xxhash64("id", salt).alias("h"), F.col("id").alias("v"))
        m = written(joined.select("id", F.least("m", own)["v"].alias("r")))
        maps.append(m)
        to_a, to_b = (m.select(F.col("id").alias(c), F.col("r").alias(f"r{c}")) for c in "ab")
        moved = e.join(to_a, "a").join(to_b, "b")
        last, e = e, written(moved.where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        discard(last)
    discard(e)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    found = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("id").alias("r"), F.col("r").alias("_next"))
        found = found.join(step, "r", "left").select("id", F.coalesce("_next", "r").alias("r"))
    found = written(found)
    discard(*maps)
    least = found.groupBy("r").agg(F.min(F.least("id", "r")).alias("component"))
    return found.join(least, "r").select("id", "component")
