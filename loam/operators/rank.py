"""Ranking of candidates within a query: caps, quotas, gaps, diversity, re-ranking. Candidates have qid and rank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import best_fuzzy, search_key


def ranked(df: DataFrame, *order: Column | str, by: str = "qid", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def deduplicated(df: DataFrame, key: Column, by: str = "qid", order: str = "rank") -> DataFrame:
    """The first row of each key within a query, ranked anew."""
    first = df.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_k").orderBy(order)))
    return ranked(first.where("_n = 1").drop("_k", "_n"), order, by=by, name=order)


def document_key(doc: Column, title: Column, section: Column, id_: Column, compat: bool = False) -> Column:
    """doc_id, else title and section, else the id. In compat mode rows without any of the first share one key."""
    pair = F.concat_ws("\x1f", F.coalesce(title, F.lit("")), F.coalesce(section, F.lit("")))
    if compat:
        return F.coalesce(doc.cast("string"), pair)
    return F.coalesce(doc.cast("string"), F.when(title.isNotNull() | section.isNotNull(), pair), id_.cast("string"))


def capped(df: DataFrame, key: str, cap: int = 2, by: str = "qid", order: str = "rank") -> DataFrame:
    """At most `cap` rows of a key within a query, in rank order; 0 or less: all."""
    if cap <= 0:
        return df
    n = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    return ranked(df.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n"), order, by=by, name=order)


def with_quota(df: DataFrame, key: str, quota: dict, k: int, by: str = "qid", order: str = "rank") -> DataFrame:
    """k rows a query: up to quota[key] of each key first, in rank order, then the rest in rank order."""
    n = F.row_number().over(Window.partitionBy(by, key).orderBy(order))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in quota.items() for x in p]), F.col(key)) if quota else F.lit(0), F.lit(0))
    flagged = df.withColumn("in_quota", F.coalesce(n <= most, F.lit(False)))
    out = ranked(flagged, F.col("in_quota").desc(), F.col(order), by=by, name="_place")
    return out.where(F.col("_place") <= k).drop(order).withColumnRenamed("_place", order)


def gaps(df: DataFrame, by: str = "qid", score: str = "score", order: str = "rank") -> DataFrame:
    """n, gap and rel_gap a query: first score less last, and that by the first, to four places."""
    first, last = F.min_by(score, order), F.max_by(score, order)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(first - last, 4).alias("gap"), F.round(F.try_divide(first - last, first), 4).alias("rel_gap"))


def expanded(hits: DataFrame, chunks: DataFrame, docs: int = 3, each: int = 2, first_sections: tuple[str, ...] = ("요약", "본문"), by: str = "qid") -> DataFrame:
    """For the first `docs` documents of a query's hits (qid, id, doc_id, rank) up to `each` other chunks (id, doc_id, section, score).

    Returns qid, doc_id, id, extra_rank. Sections named come first, then higher scores. An equality join on doc_id; the
    chunks of a document are bounded by it.
    """
    order = F.lit(len(first_sections))
    for k, s in reversed(list(enumerate(first_sections))):
        order = F.when(F.col("section") == s, k).otherwise(order)
    per = ranked(hits.where("doc_id IS NOT NULL").groupBy(by, "doc_id").agg(F.min("rank").alias("rank")), "rank", by=by, name="_d").where(F.col("_d") <= docs)
    more = per.select(by, "doc_id").join(chunks, "doc_id").join(hits.select(by, "id"), [by, "id"], "left_anti")
    n = F.row_number().over(Window.partitionBy(by, "doc_id").orderBy(order, F.coalesce("score", F.lit(0.0)).desc(), "id"))
    return more.withColumn("extra_rank", n).where(F.col("extra_rank") <= each).select(by, "doc_id", "id", "extra_rank")


def mmr_order(sim: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy maximal marginal relevance; of equals the first. k rows or fewer stay in their order."""
    if len(sim) <= k:
        return list(range(len(sim)))
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-8)
    chosen = [int(np.argmax(np.round(sim, 9)))]
    near = unit @ unit[chosen[0]]
    free = np.ones(len(sim), bool)
    free[chosen[0]] = False
    while len(chosen) < k:
        # rounded, so that what ties but for the last digits of sums goes by place
        worth = np.where(free, np.round(weight * sim - (1 - weight) * near, 9), -np.inf)
        i = int(np.argmax(worth))
        chosen.append(i)
        free[i] = False
        near = np.maximum(near, unit @ unit[i])
    return chosen


def mmr(df: DataFrame, k: int, weight: float = 0.5, by: str = "qid") -> DataFrame:
    """(qid, vec_id, rank) of candidates (qid, qv, vec_id, embedding, rank): relevance against likeness to those chosen before.

    Sequential by nature, so one query's candidates, bounded by the search before, are one Arrow group.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        v = np.array(g["embedding"].tolist(), dtype=np.float64)
        q = np.array(g["qv"].iloc[0], dtype=np.float64)
        sim = v @ q / (np.linalg.norm(v, axis=1) + 1e-8) / (np.linalg.norm(q) + 1e-8)
        order = mmr_order(sim, v, k, weight)
        return pd.DataFrame({by: g[by].to_numpy()[order], "vec_id": g["vec_id"].to_numpy()[order], "rank": np.arange(1, len(order) + 1)})

    return df.select(by, "qv", "vec_id", "embedding", "rank").groupBy(by).applyInPandas(run, f"{by} long, vec_id long, rank int")


def title_mmr(df: DataFrame, k: int, penalty: float = 0.6, by: str = "qid", title: str = "title") -> DataFrame:
    """Greedy order by score less `penalty` for a title chosen before: the first of each title by score, the others behind."""
    n = F.row_number().over(Window.partitionBy(by, title).orderBy(F.col("score").desc(), "rank"))
    worth = F.col("score") - F.when(n > 1, penalty).otherwise(0.0)
    return ranked(df.withColumn("_w", worth), F.col("_w").desc(), F.col("rank"), by=by, name="_place").where(F.col("_place") <= k).drop("_w", "rank").withColumnRenamed("_place", "rank")


def reranked(df: DataFrame, scorer, k: int, query: str = "query", text: str = "text", most: int | None = 800, by: str = "qid") -> DataFrame:
    """The k rows that a scorer(query column, text column) puts first; texts are cut at `most` signs for a scorer whose input is bounded (None: not)."""
    df = df.withColumn("rerank_score", scorer(F.col(query), F.col(text) if most is None else F.substring(text, 1, most)))
    return ranked(df.drop("rank"), F.col("rerank_score").desc(), *(["id"] if "id" in df.columns else []), by=by).where(F.col("rank") <= k)


def paged(df: DataFrame, *order: Column | str, each: int = 10, by: str | None = None) -> DataFrame:
    """df with `page` from 0 and `line` from 0 on it, `each` lines a page, within each value of `by`; without one, of all rows."""
    n = F.row_number().over((Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / each).cast("int")).withColumn("line", (F.col("_n") % each).cast("int")).drop("_n")


def title_boost(title: Column, variants: Column, normal_form: bool = True) -> Column:
    """0 to 1: how well a title fits the best of a query's variants, both compared by their search keys; 0 without a title."""
    keys = F.transform(F.coalesce(variants, F.array().cast("array<string>")), lambda v: search_key(v, False))
    key = search_key(title, normal_form)
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).otherwise(F.coalesce(best_fuzzy(key, keys), F.lit(0.0)))


def with_title_boost(df: DataFrame, boost: Column, weight: float = 0.2) -> DataFrame:
    return df.withColumn("combo", (1 - weight) * F.coalesce("score", F.lit(0.0)) + weight * boost)
