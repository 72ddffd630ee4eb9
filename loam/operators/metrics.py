"""Measures of retrieval: hits, ranks, gains, repeats, percentiles, comparison of two strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import strip
from loam.sources import tables


def hit_and_rank(hits: DataFrame, relevant: Column, k: int, by: str = "qid") -> DataFrame:
    """hit (0 or 1) and rr (1 / first relevant rank, 0 without) a query within the first k."""
    first = F.min(F.when(relevant & (F.col("rank") <= k), F.col("rank")))
    return hits.groupBy(by).agg(F.coalesce(F.signum(first), F.lit(0)).cast("int").alias("hit"), F.coalesce(1 / first, F.lit(0.0)).alias("rr"))


def gold_match(mode: str, item_id: Column, title: Column, url: Column, gold_ids: Column, gold_title: Column, gold_url: Column) -> Column:
    """Whether a hit is the wanted one: by "chunk" (its id is among the gold ids), "title" or "page" (equal and not blank, stripped)."""
    if mode == "chunk":
        return F.coalesce(F.array_contains(gold_ids, item_id.cast("string")), F.lit(False))
    own, gold = (title, gold_title) if mode == "title" else (url, gold_url)
    wanted = strip(F.coalesce(gold, F.lit("")))
    return (wanted != "") & (strip(F.coalesce(own, F.lit(""))) == wanted)


def recalls(strategies: dict[str, DataFrame], relevant: Column, k: int = 50, by: str = "qid") -> DataFrame:
    """strategy, n and recall at k: the share of queries with a relevant hit among the first k, as before re-ranking."""
    out = None
    for name, hits in strategies.items():
        per = hit_and_rank(hits, relevant, k, by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall"))
        per = per.select(F.lit(name).alias("strategy"), "n", "recall")
        out = per if out is None else out.unionByName(per)
    return out


def sampled_documents(chunks: DataFrame, most: int, section: str | None = None, seed: int = 42) -> DataFrame:
    """At most `most` documents of chunks (id, doc_id, title, section) with their place in a seeded shuffle.

    A document's key is its doc_id, else its chunk's id; its first chunk by id stands for it. The shuffle goes by md5 of the
    seed and the key, so the sample doesn't hang on how rows lie; the best are kept before they meet.
    """
    rows = chunks if section is None else chunks.where(F.col("section") == section)
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.col("id").cast("string"), F.concat_ws("|", "title", "section")))
    first = rows.groupBy("key").agg(F.min(F.struct("id", "title")).alias("f"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), "key"))
    some = first.select("key", "f.id", "f.title", draw.alias("draw")).orderBy("draw", "key").limit(most)
    return some.withColumn("place", F.row_number().over(Window.orderBy("draw", "key"))).drop("draw")


def ndcg(hits: DataFrame, relevant: Column, n_relevant: Column, k: int, by: str = "qid") -> DataFrame:
    """Binary gains, ideal order over min(k, n_relevant) places; repeated keys each count, so it may pass 1."""
    gain = F.sum(F.when(relevant & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.max(n_relevant)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return hits.groupBy(by).agg(F.when(F.max(n_relevant) > 0, gain / ideal).otherwise(0.0).alias("ndcg"))


def dup_rate(keys: Column) -> Column:
    """Share of repeats in a list of keys; 0 for one or none."""
    n = F.size(keys)
    return F.when(n <= 1, 0.0).otherwise(1 - F.size(F.array_distinct(keys)) / n)


def nearest_rank(value: str, p: float) -> Column:
    """The value at place ceil(p * n) of the sorted values; 0 without any."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def nearest_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float], parts: int = 64) -> DataFrame:
    """For each group the values at place ceil(p * n) of its sorted values, one column a share p; exact, however large a group.

    Sketched quantiles cut a group into about `parts` ranges; their counts tell in which range each place lies, and only the
    rows of those ranges are sorted. No task holds a group. A sketch hangs on the order in which its parts arrive, so the cuts,
    which counts and sorted rows must share, are written once and read by both.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    cuts = rows.groupBy(F.col("g").alias("cg")).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.percentile_approx("v", [k / parts for k in range(1, parts)], 2 * parts)).alias("cuts"))
    cuts = tables.kept(cuts)
    placed = rows.join(cuts, F.col("g").eqNullSafe(F.col("cg"))).select("g", "v", "n", "cuts", F.lit(0).alias("part"))
    step = 1 << (parts.bit_length() - 1)
    while step:  # how many of the ascending cuts are below the value, by halving
        below = F.coalesce(F.get("cuts", F.col("part") + (step - 1)) < F.col("v"), F.lit(False))
        placed = placed.select("g", "v", "n", "cuts", (F.col("part") + F.when(below, step).otherwise(0)).alias("part"))
        step //= 2
    placed = placed.drop("cuts")
    counts = placed.groupBy("g", "n", "part").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("c"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).alias("at")) for name, p in shares.items()])).alias("w")
    held = counts.select("g", "part", "begin", "end", wanted).where((F.col("w.at") > F.col("begin")) & (F.col("w.at") <= F.col("end")))
    held = held.groupBy("g", "part", "begin").agg(F.collect_list("w").alias("ws"))
    held = held.select(F.col("g").alias("hg"), F.col("part").alias("hp"), "begin", "ws")
    inner = placed.join(held, F.col("g").eqNullSafe(F.col("hg")) & (F.col("part") == F.col("hp")))
    numbered = inner.withColumn("place", F.col("begin") + F.row_number().over(Window.partitionBy("g", "part").orderBy("v")))
    hit = numbered.select("g", "v", F.explode("ws").alias("w"), "place").where("place = w.at")
    return hit.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in shares])


def mean_or_zero(value: str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def win_rate(pairs: DataFrame, a: str, b: str, lower_is_better: bool = False) -> DataFrame:
    """n, wins, ties and win_rate of b over a: wins and half of the ties among all."""
    win = F.col(b) < F.col(a) if lower_is_better else F.col(b) > F.col(a)
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(win).alias("wins"), F.count_if(F.col(a) == F.col(b)).alias("ties"))
    return out.withColumn("win_rate", F.coalesce(F.try_divide(F.col("wins") + F.col("ties") / 2, F.col("n")), F.lit(0.0)))


def bootstrap(df: DataFrame, value: str, iterations: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """mean, low and high: percentile interval of the mean over resamples.

    Each row counts Poisson(1) times in each resample, drawn from hashes of the row's key and the resample, which needs
    no draw from all rows: rows are summed where they are, and `iterations` sums cross the shuffle. df: key, `value`.
    """
    limits, total, p = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += p
        limits.append(total)
        p /= k + 1
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("key").cast("string"), F.col("i").cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    times = sum((F.when(u >= x, 1).otherwise(0) for x in limits), F.lit(0))
    each = df.select("key", value, F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("i")).withColumn("w", times)
    means = each.groupBy("i").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("m"))
    tail = round((1 - level) / 2, 12)
    return means.agg(F.avg("m").alias("mean"), F.expr(f"percentile_disc({tail}) WITHIN GROUP (ORDER BY m)").alias("low"), F.expr(f"percentile_disc({round(1 - tail, 12)}) WITHIN GROUP (ORDER BY m)").alias("high"))
