"""Incremental ingest: chunks that arrive as a stream, each once, upserted into a table batch by batch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.operators.upsert import latest


def once(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once while its state is held: rows later than the watermark are dropped with it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counted(stream: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows per window and `by`, with late rows up to the delay."""
    w = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return w.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of a table's complete versions, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
    return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v{n}/_SUCCESS")))


def upsert_batch(table: str, keys: list[str], order: str, keep: int = 2):
    """For foreachBatch: writes a new version of a table of numbered versions, of which the last `keep` stay.

    Of a key the row of greatest `order` counts, whichever batch brought it, so late rows change nothing newer. A batch goes
    on from the newest complete version before its own number, so numbers may have gaps, and run twice it leaves the same
    rows. Each batch rewrites the table: let them be few and large.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        before = [n for n in versions(spark, table) if n < number]
        rows = batch
        if before:
            rows = spark.read.schema(batch.schema).parquet(f"{table}/v{before[-1]}").unionByName(batch)
        latest(rows, keys, order).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/v{number}")
        for n in before[: len(before) + 1 - keep]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v{n}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return run


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Takes all that is there and stops; state and progress are kept in the checkpoint for the next call."""
    return stream.writeStream.foreachBatch(upsert_batch(table, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
