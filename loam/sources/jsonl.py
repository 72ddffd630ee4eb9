"""JSON lines in and out: tolerant, counting or strict; text in several encodings; title lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "title string, url string, parent string, metadata struct<seed_title:string,depth:int,fetched_at:string>, chunks array<string>, content string"


#: Names of the files of a folder that are read.
FILES = "*.{json,jsonl}"


def read(spark: SparkSession, path: str | list[str], schema: str = PAGE, mode: str = "skip", files: str = FILES) -> DataFrame:
    """Rows of JSON lines; of a folder the files directly in it that `files` names. mode: skip bad lines, keep them in `_corrupt`, or fail."""
    how = {"skip": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}[mode]
    fields = f"{schema}, _corrupt string" if mode == "keep" else schema
    reader = spark.read.schema(fields).option("mode", how).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", files)
    return reader.json(path)


def numbered_lines(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    """file, line_no from 1, and line of the lines that aren't blank; blank ones count.

    Files are split as any: lines are numbered within a block, and each block's lines before it are added, of which there is
    one number a block.
    """
    lines = spark.read.option("pathGlobFilter", files).text(path)
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = lines.select(*block, F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    blocks = lines.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return lines.where("trim(line) <> ''").join(blocks, ["file", "block"]).select("file", (F.col("mid") + F.col("shift")).alias("line_no"), "line")


def read_numbered(spark: SparkSession, path: str, schema: str = PAGE, files: str = FILES) -> DataFrame:
    """As read, with file and line number; lines that aren't JSON give no row."""
    each = numbered_lines(spark, path, files).where(F.try_parse_json("line").isNotNull())
    row = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    return each.select("file", "line_no", row.alias("r")).select("file", "line_no", "r.*")


def faults(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    """file, line_no and line of the lines that aren't JSON, as a reader would warn of."""
    return numbered_lines(spark, path, files).where(F.try_parse_json("line").isNull())


def read_text(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "utf-16", "x-windows-949", "iso-8859-1")) -> DataFrame:
    """file and text of files in the first encoding that decodes them without a fault; a byte-order mark is dropped."""
    raw = spark.read.format("binaryFile").load(path)

    def one(content: bytes) -> str:
        if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return content.decode("utf-16", "replace")
        for e in encodings:
            try:
                return content.decode({"x-windows-949": "cp949"}.get(e, e)).removeprefix(chr(0xFEFF))
            except UnicodeError:
                continue
        return content.decode("utf-8", "replace")

    @F.arrow_udf(T.StringType())
    def decoded(s: pa.Array) -> pa.Array:
        return pa.array([one(b.as_py()) for b in s], pa.string())

    return raw.select(F.col("path").alias("file"), decoded("content").alias("text"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """group, pos and title from a JSON object of lists, groups in order of name."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.array_sort(F.map_entries(F.from_json("value", "map<string, array<string>>")))).alias("e")
    return text.select(entries).select(F.col("e.key").alias("group"), F.posexplode("e.value").alias("pos", "title"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """kind ("regex" or "text") and pattern from a list: `re:` marks a regular expression, # a comment."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")))
    return rows.select(F.when(F.startswith(line, F.lit("re:")), "regex").otherwise("text").alias("kind"), F.regexp_replace(line, "^re:", "").alias("pattern"))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with all keys, null ones too."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def file_name(seed: Column) -> Column:
    """A seed as a file name: reserved signs to underscores, at most 180 signs."""
    return F.substring(F.regexp_replace(seed, r'["*/:<>?\\|]', "_"), 1, 180)


def write_by_seed(df: DataFrame, path: str, seed: str = "seed") -> None:
    """One folder a seed."""
    df.withColumn("file", file_name(F.col(seed))).write.mode("overwrite").partitionBy("file").json(path)
