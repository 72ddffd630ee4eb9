"""Parquet tables of a folder, and collections: tables of (id, text, metadata, embedding)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch at most: a Python worker holds a batch, what it makes of it, and no more.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches from here on, where the session allows larger ones, as texts may be long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        if not 0 < size(str(spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Arrow batches are small from here on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_made() -> None:
    for spark, path in _made:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session has stopped
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in spark.checkpoint.dir, deleted when the program ends; where that is unset a
    local one, which only a local master may have."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        _made.append((spark, f"{root.rstrip('/')}/loam-{uuid.uuid4().hex}"))
        return _made[-1][1]
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loam-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"{made}/data"


def kept(df: DataFrame) -> DataFrame:
    """df, written in a folder that all executors share and read again: worked out once, however often it is used."""
    where = shared_folder(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def retried(write: Callable[[], None], times: int = 3, pause: float = 0.8) -> None:
    """Calls write until it succeeds, at most `times` times, waiting longer after each failure; the last one is raised."""
    for k in range(1, times + 1):
        try:
            return write()
        except Exception:
            if k == times:
                raise
            time.sleep(pause * k)


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, Exception | None]:
    """Writes df to every sink, whatever becomes of the others; what each failed with, or None."""
    out: dict[str, Exception | None] = {}
    for name, write in sinks.items():
        try:
            write(df)
            out[name] = None
        except Exception as e:  # one sink's failure is told, and no other's business
            out[name] = e
    return out


def peek(df: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(key).limit(n)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def length_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """n, least, median (lower of two), mean and most of the lengths of all texts."""
    n = F.length(text)
    rows = df.where(F.col(text).isNotNull()).select(n.alias("n"))
    return rows.agg(F.count("n").alias("n_texts"), F.min("n").alias("least"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def write_one_text(df: DataFrame, path: str, name: str = "lines.txt") -> None:
    """One text file `name` in the folder `path`, of a sorted df of one string column: written in parts by all tasks, whose
    bytes are then put one behind the other in the order of their names, which is the order of the partitions."""
    spark = df.sparkSession
    parts = shared_folder(spark)
    df.write.text(parts)
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    to = target.getFileSystem(conf)
    to.mkdirs(target)
    out = to.create(hadoop.fs.Path(target, name))
    try:
        for p in files:
            read = fs.open(p)
            try:
                hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            finally:
                read.close()
    finally:
        out.close()
    fs.delete(source, True)


def write_collection(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)
