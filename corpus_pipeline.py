"""From raw documents to packed sequences: five operators in turn, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loam.llm._shared import discard, discard_folders, recorded, table, written
from loam.llm.mixing import mixing_stage
from loam.llm.packing import packing_stage
from loam.llm.quality import quality_stage
from loam.llm.simhash_dedup import simhash_stage
from loam.llm.suffix_dedup import suffix_stage

#: Folders that the stage called last wrote for itself.
_left: list[str] = []


def _in_turn(stage: Callable) -> Callable:
    """stage, which first deletes what the stage before it wrote for itself: that one's result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_folders(_left, docs)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left[:] = made
        return out

    return run_stage


#: Name and function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents. A stage's result is to
#: be written before the next stage is called, which deletes what the one before wrote for itself.
STAGES = [
    ("quality classifier", _in_turn(quality_stage)),
    ("SimHash near-dedup", _in_turn(simhash_stage)),
    ("suffix-array dedup", _in_turn(suffix_stage)),
    ("mixing", _in_turn(mixing_stage)),
    ("packing", _in_turn(packing_stage)),
]

#: SQL can't express the classifier; tests hold the pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a folder through the stages; what each returns is written in the shared folder and read again.

    What a stage wrote for itself is deleted once its result is there, and that once the next one's is. An empty table
    gives no rows; for nulls, empty and long texts, ties, repeated rows and further columns see the stages.
    """
    _left.clear()  # a run before may not have been read yet
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        following = written(stage(spark, docs, sf_dir))
        discard(docs)
        docs = following
    out = STAGES[-1][1](spark, docs, sf_dir)
    _left.clear()
    return out
