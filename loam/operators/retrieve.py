"""Retrieval strategies: search, score, first of each document, cap by title, diversity, re-ranking, confidence, context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.chunk import context_text
from loam.functions.vector import confidence_minmax, confidence_softmax

from .knn import filtered, top_k
from .rank import capped, deduplicated, mmr, ranked, reranked, with_quota, with_title_boost


@dataclass(frozen=True)
class Settings:
    """Sizes of the steps; a search fetches 1 to 100 candidates, whatever is asked for."""

    fetch: int = 100
    cap: int = 2
    diverse: bool = True
    before_mmr: int = 120
    weight: float = 0.5
    rerank_in: int = 24
    min_confidence: float = 0.2
    min_score: float | None = None


def candidates(queries: DataFrame, vectors: DataFrame, n: int, where: dict | None = None, metric: str = "cosine", leave_out: str | None = "qid") -> DataFrame:
    """The hits of queries (qid, qv, ...) among vectors (vec_id, embedding, ...), with the columns of both; leave_out as in top_k."""
    hits = top_k(queries, filtered(vectors, where), min(max(n, 1), 100), metric, leave_out=leave_out)
    return hits.join(vectors, "vec_id").join(queries, "qid")


def baseline(queries: DataFrame, vectors: DataFrame, k: int, settings: Settings = Settings(), *, title: str = "title", document: str = "doc_id", where: dict | None = None, scorer=None, text: str = "text", leave_out: str | None = "qid") -> DataFrame:
    """(qid, vec_id, rank, score): candidates, one of each document, `cap` of each title, then MMR or the head, then re-ranking."""
    hits = candidates(queries, vectors, settings.fetch, where, leave_out=leave_out)
    if settings.min_score is not None:
        hits = hits.where(F.col("score") >= settings.min_score)
    hits = deduplicated(hits, F.col(document).cast("string"))
    hits = capped(hits, title, settings.cap)
    return _finish(hits, k, settings, scorer, text)


def _finish(hits: DataFrame, k: int, settings: Settings, scorer, text: str) -> DataFrame:
    if settings.diverse:
        head = hits.where(F.col("rank") <= settings.before_mmr)
        order = mmr(head, max(4 * k, 40), settings.weight)
        hits = head.drop("rank").join(order, ["qid", "vec_id"])
    else:
        hits = hits.where(F.col("rank") <= max(12 * k, 120))
    if scorer is not None:
        hits = reranked(hits.where(F.col("rank") <= settings.rerank_in), scorer, k, text=text)
        return hits.select("qid", "vec_id", "rank", "score", "rerank_score")
    return hits.where(F.col("rank") <= k).select("qid", "vec_id", "rank", "score")


def multi_query(variants: DataFrame, vectors: DataFrame, k: int, boost=None, settings: Settings = Settings(before_mmr=160), *, title: str = "title", document: str = "doc_id", scorer=None, text: str = "text", leave_out: str | None = "qid") -> DataFrame:
    """As baseline over several variants of a query (qid, variant, qv): max(8k, 80) hits of the first, max(4k, 40) of the others."""
    hits = top_k(variants, vectors, min(max(8 * k, 80), 100), leave_out=leave_out, variant="variant")
    hits = hits.where((F.col("variant") == 0) | (F.col("rank") <= max(4 * k, 40)))
    best = hits.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    first = variants.where("variant = 0").drop("variant")
    rows = best.join(vectors, "vec_id").join(first, "qid")
    rows = with_title_boost(rows, boost if boost is not None else F.lit(0.0))
    rows = ranked(rows, F.col("combo").desc(), "vec_id")
    rows = capped(deduplicated(rows, F.col(document).cast("string")), title, settings.cap)
    return _finish(rows, k, settings, scorer, text)


def answers(hits: DataFrame, settings: Settings = Settings(), quota: dict | None = None, k: int = 8) -> DataFrame:
    """One row a query from hits (qid, rank, score, title, section, text): confidence, abstained, context.

    Below the least confidence there is no context. With a quota the rows are chosen by section first.
    """
    scored = "rerank_score" if "rerank_score" in hits.columns else "score"
    chosen = with_quota(hits, "section", quota, k) if quota else hits.where(F.col("rank") <= k)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(scored).alias("s"), "title", "section", "text")))
    per = chosen.groupBy("qid").agg(rows.alias("items"))
    values = F.transform("items", lambda x: x["s"])
    sure = confidence_softmax(values) if scored == "rerank_score" else confidence_minmax(values)
    per = per.withColumn("confidence", sure).withColumn("abstained", F.col("confidence") < settings.min_confidence)
    return per.select("qid", "confidence", "abstained", F.when(~F.col("abstained"), context_text(F.col("items"))).alias("context"))
