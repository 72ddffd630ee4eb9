"""Queries over the test tables, each with the SQL it must agree with.

Stand-ins: documents are works (source: seed, lang: section), lines of a document its chunks, embeddings the vectors of
chunks (label: title or document), events measured latencies, orders and customers keyed records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import chunk, html, ids, noise, text, vector
from loam.functions.registry import embedder, scorer, summarised
from loam.operators import assemble, crawl, knn, metrics, rank, retrieve, upsert
from loam.plans import pages, records  # noqa: F401  (register their queries)
from loam.plans.registry import QUERIES, SQL, query
from loam.sources.tables import length_statistics, table

def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# search

def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return _vectors(spark, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))


def _hits(spark: SparkSession, d: str, k: int, metric: str = "cosine", where: dict | None = None) -> DataFrame:
    return knn.search(_queries(spark, d), _vectors(spark, d), k, where, metric=metric)


def _labelled(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Hits with the labels of query and vector."""
    labels = _vectors(spark, d).select("vec_id", "label")
    return _hits(spark, d, k).join(labels, "vec_id").join(_queries(spark, d).select("qid", "ql"), "qid")


SCORE = {
    "cosine": "1 - (1 - list_cosine_similarity(qv, v)) / 2",
    "l2": "1 / (1 + list_distance(qv, v) * list_distance(qv, v))",
    "ip": "1 / (1 + exp(-list_inner_product(qv, v)))",
}


def _hits_sql(k: int, metric: str = "cosine", where: str = "true") -> str:
    return f"""q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE {where}),
s AS (SELECT qid, vec_id, ql, label, v, qv, round(least(1.0, greatest(0.0, {SCORE[metric]})), 6) AS score FROM q JOIN v ON vec_id <> qid),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= {k})"""


@query(f"WITH {_hits_sql(5)} SELECT qid, vec_id, rank, score FROM h")
def knn_cosine_topk(spark, d):
    return _hits(spark, d, 5)


@query(f"WITH {_hits_sql(5, 'l2')} SELECT qid, vec_id, rank, score FROM h")
def knn_l2_topk(spark, d):
    return _hits(spark, d, 5, "l2")


@query(f"WITH {_hits_sql(5, 'ip')} SELECT qid, vec_id, rank, score FROM h")
def knn_ip_topk(spark, d):
    return _hits(spark, d, 5, "ip")


@query(f"WITH {_hits_sql(5, 'cosine', 'label IN (1, 3)')} SELECT qid, vec_id, rank, score FROM h")
def knn_filtered(spark, d):
    return _hits(spark, d, 5, where={"label": [1, 3]})


@query(f"WITH {_hits_sql(20)}, m AS (SELECT * FROM h WHERE score >= 0.65) SELECT qid, COUNT(*) AS n, round(max(score) - min(score), 4) AS gap, round((max(score) - min(score)) / max(score), 4) AS rel_gap FROM m GROUP BY qid")
def knn_min_score_gap(spark, d):
    return rank.gaps(_hits(spark, d, 20).where("score >= 0.65"))


@query(f"WITH {_hits_sql(30)}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM h) SELECT qid, vec_id, label, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank FROM c WHERE n <= 2")
def title_cap(spark, d):
    return rank.capped(_labelled(spark, d, 30), "label").select("qid", "vec_id", "label", "rank")


@query(f"WITH {_hits_sql(30)}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM h) SELECT qid, vec_id, label, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS rank FROM c WHERE n = 1")
def candidate_dedup(spark, d):
    hits = _labelled(spark, d, 30)
    key = rank.document_key(F.col("label"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("vec_id"))
    return rank.deduplicated(hits, key).select("qid", "vec_id", "label", "rank")


@query(f"""WITH {_hits_sql(30)}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) <= CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS in_quota FROM h),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY in_quota DESC, rank) AS INT) AS place FROM c) SELECT qid, vec_id, label, in_quota, place AS rank FROM p WHERE place <= 8""")
def section_quota(spark, d):
    return rank.with_quota(_labelled(spark, d, 30), "label", {1: 2, 2: 1, 3: 3}, 8).select("qid", "vec_id", "label", "in_quota", "rank")


@query(f"""WITH {_hits_sql(5)}, m AS (SELECT qid, max(score) FILTER (rank <= 3) AS hi, min(score) FILTER (rank <= 3) AS lo, avg(score) FILTER (rank <= 3) AS mean, max(score) AS top, list(score) AS all_ FROM h GROUP BY qid)
SELECT qid, round(CASE WHEN hi - lo < 1e-6 THEN hi ELSE (mean - lo) / (hi - lo) END, 6) AS minmax, round(1 / (list_sum(list_transform(all_, lambda x: exp(x - top))) + 1e-8), 6) AS softmax FROM m""")
def confidence(spark, d):
    s = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    per = _hits(spark, d, 5).groupBy("qid").agg(s.alias("s"))
    return per.select("qid", F.round(vector.confidence_minmax(F.col("s")), 6).alias("minmax"), F.round(vector.confidence_softmax(F.col("s")), 6).alias("softmax"))


@query(f"""WITH {_hits_sql(10)}, {_hits_sql(6, 'l2').replace('q AS', 'q2 AS').replace('v AS (SELECT vec_id', 'v2 AS (SELECT vec_id').replace('FROM q JOIN v', 'FROM q2 JOIN v2').replace('s AS (SELECT', 's2 AS (SELECT').replace('FROM s ', 'FROM s2 ').replace('h AS (SELECT', 'h2 AS (SELECT')},
u AS (SELECT qid, vec_id, rank FROM h UNION ALL SELECT qid, vec_id, rank + 100 FROM h2), f AS (SELECT qid, vec_id, min(rank) AS r FROM u GROUP BY ALL)
SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY r) AS INT) AS rank FROM f""")
def multi_query_union(spark, d):
    more = _hits(spark, d, 6, "l2").withColumn("rank", F.col("rank") + 100)
    both = _hits(spark, d, 10).unionByName(more).groupBy("qid", "vec_id").agg(F.min("rank").alias("r"))
    return rank.ranked(both, "r").select("qid", "vec_id", "rank")


@query(f"""WITH {_hits_sql(4)}, t0 AS (SELECT qid, label, min(rank) AS r FROM h GROUP BY qid, label), t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) <= 3),
m AS (SELECT t.qid, t.label AS doc_id, e.vec_id AS id, row_number() OVER (PARTITION BY t.qid, t.label ORDER BY e.vec_id) AS n FROM t JOIN embeddings e ON e.label = t.label WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = t.qid AND h.vec_id = e.vec_id))
SELECT qid, doc_id, id, CAST(n AS INT) AS extra_rank FROM m WHERE n <= 2""")
def same_doc_expand(spark, d):
    hits = _labelled(spark, d, 4).select("qid", F.col("vec_id").alias("id"), F.col("label").alias("doc_id"), "rank")
    chunks = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("label").alias("doc_id"), F.lit("").alias("section"), F.lit(0.0).alias("score"))
    # only the first few chunks of a document can be taken, as at most four of them are hits already
    per = rank.ranked(chunks, "id", by="doc_id", name="_n").where("_n <= 6").drop("_n")
    return rank.expanded(hits, per)


@query(f"""WITH RECURSIVE {_hits_sql(60)},
c AS (SELECT qid, vec_id, rank, list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) + 1e-8) / (sqrt(list_inner_product(qv, qv)) + 1e-8) AS sim, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) AS unit FROM h),
r AS (SELECT qid, 1 AS step, [arg_max(vec_id, round(sim, 9) - rank * 1e-13)] AS chosen, [arg_max(unit, round(sim, 9) - rank * 1e-13)] AS units FROM c GROUP BY qid
UNION ALL SELECT qid, step, list_append(chosen, vec_id), list_append(units, unit) FROM (
SELECT c.qid, r.step + 1 AS step, any_value(r.chosen) AS chosen, any_value(r.units) AS units, arg_max(c.vec_id, w - c.rank * 1e-13) AS vec_id, arg_max(c.unit, w - c.rank * 1e-13) AS unit FROM
(SELECT c.*, r.step, r.chosen, r.units, round(0.5 * c.sim - 0.5 * list_max(list_transform(r.units, lambda u: list_inner_product(u, c.unit))), 9) AS w FROM r JOIN c ON c.qid = r.qid AND NOT list_contains(r.chosen, c.vec_id) WHERE r.step < 10) AS c JOIN r ON r.qid = c.qid GROUP BY c.qid, r.step))
SELECT qid, unnest(chosen) AS vec_id, CAST(unnest(range(1, 11)) AS INT) AS rank FROM r WHERE step = 10""")
def mmr_rerank(spark, d):
    hits = retrieve.candidates(_queries(spark, d), _vectors(spark, d), 60)
    return rank.mmr(hits, 10)


@query(f"WITH {_hits_sql(100)}, c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM h), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS place FROM c WHERE n <= 2) SELECT qid, vec_id, place AS rank, score FROM r WHERE place <= 5")
def retrieve_baseline(spark, d):
    """After two of each title at most 20 candidates are left, fewer than what the diversity step would choose among."""
    v = _vectors(spark, d).withColumn("title", F.col("label")).withColumn("doc_id", F.col("vec_id"))
    return retrieve.baseline(_queries(spark, d).select("qid", "qv"), v, 5)


@query(f"""WITH {_hits_sql(80)}, q1 AS (SELECT qid, ql, list_transform(qv, lambda x: CAST(CAST(x / (sqrt(list_inner_product(qv, qv)) + 1e-8) AS FLOAT) AS DOUBLE)) AS qv FROM q),
s1 AS (SELECT qid, vec_id, ql, label, round(least(1.0, greatest(0.0, {SCORE["cosine"]})), 6) AS score FROM q1 JOIN v ON vec_id <> qid),
h1 AS (SELECT qid, vec_id, ql, label, score FROM s1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 40),
b AS (SELECT qid, vec_id, ql, label, max(score) AS score FROM (SELECT qid, vec_id, ql, label, score FROM h UNION ALL SELECT * FROM h1) GROUP BY ALL),
o AS (SELECT *, (1 - CAST(0.2 AS DOUBLE)) * score + CAST(0.2 AS DOUBLE) * CASE WHEN label = ql THEN 1 ELSE 0 END AS combo FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY combo DESC, vec_id) AS n FROM o),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY combo DESC, vec_id) AS INT) AS place FROM c WHERE n <= 2)
SELECT qid, vec_id, place AS rank, score FROM r WHERE place <= 5""")
def retrieve_multi_query(spark, d):
    """A query and its normalised form, candidates of both, those first whose title fits the query."""
    v = _vectors(spark, d).withColumn("title", F.col("label")).withColumn("doc_id", F.col("vec_id"))
    q = _queries(spark, d)
    variants = q.select("qid", F.lit(0).alias("variant"), "qv", "ql").unionByName(q.select("qid", F.lit(1).alias("variant"), vector.normalised(F.col("qv")).alias("qv"), "ql"))
    boost = rank.title_boost(F.col("title").cast("string"), F.array(F.concat(F.lit("query "), F.col("ql").cast("string"))), False)
    return retrieve.multi_query(variants, v, 5, boost)


@query(f"""WITH {_hits_sql(30)}, p AS (SELECT *, score - CASE WHEN row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, rank) > 1 THEN CAST(0.6 AS DOUBLE) ELSE 0 END AS w FROM h)
SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY w DESC, rank) AS INT) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY w DESC, rank) <= 10""")
def title_mmr(spark, d):
    """Diversity by title alone: a title chosen before costs 0.6."""
    hits = _labelled(spark, d, 30).withColumn("title", F.col("label"))
    return rank.title_mmr(hits, 10).select("qid", "vec_id", "rank")


@query(" UNION ALL ".join(f"SELECT '{name}' AS backend, * FROM (WITH {_hits_sql(5, metric, 'label >= 3 AND contains(CAST(vec_id AS VARCHAR), {0})'.format(chr(39) + '1' + chr(39)))} SELECT qid, vec_id, rank, score FROM h)" for name, metric in (("collection", "cosine"), ("flat", "l2"), ("unknown", "cosine"))))
def search_backends(spark, d):
    """The same search by each kind of index, and by one that isn't there, under a comparison and a substring."""
    v = knn.filtered(_vectors(spark, d).withColumn("tag", F.col("vec_id").cast("string")), None, "1", "tag")
    out = [knn.search_in(b, _queries(spark, d), v, 5, {"label": {"$gte": 3}}).withColumn("backend", F.lit(b)) for b in ("collection", "flat", "unknown")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {_hits_sql(50)}, raw AS (SELECT qid, max(CASE WHEN label = ql THEN 1 ELSE 0 END) AS hit FROM h GROUP BY qid),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM h), capped AS (SELECT qid, max(CASE WHEN label = ql THEN 1 ELSE 0 END) AS hit FROM c WHERE n <= 2 GROUP BY qid)
SELECT 'raw' AS strategy, COUNT(*) AS n, round(avg(hit), 6) AS recall FROM raw UNION ALL SELECT 'capped', COUNT(*), round(avg(hit), 6) FROM capped""")
def recall_before_reranking(spark, d):
    """Recall at 50 of the bare search and of what a cap by title leaves of it."""
    hits = _labelled(spark, d, 50)
    return metrics.recalls({"raw": hits, "capped": rank.capped(hits, "label")}, F.col("label") == F.col("ql"), 50).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_hits_sql(30)}, p AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) <= CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS in_quota FROM h),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY in_quota DESC, rank) AS place FROM p QUALIFY place <= 8),
a AS (SELECT qid, list(score ORDER BY place)[1:3] AS x, string_agg('[S' || place || '] t' || vec_id || ' · ' || label || chr(10) || 'text ' || vec_id, chr(10) || chr(10) ORDER BY place) AS context FROM t GROUP BY qid),
m AS (SELECT *, list_min(x) AS lo, list_max(x) AS hi, list_sum(x) AS total FROM a), c AS (SELECT *, CASE WHEN hi - lo < 1e-6 THEN x[1] ELSE (total - 3 * lo) / ((hi - lo) * 3) END AS sure FROM m)
SELECT qid, round(sure, 6) AS confidence, sure < 0.4 AS abstained, CASE WHEN sure >= 0.4 THEN md5(context) END AS context FROM c""")
def ask(spark, d):
    """From search to prompt: candidates, sections by quota, confidence, abstention, context."""
    hits = _labelled(spark, d, 30).select("qid", "rank", "score", F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("title"), F.col("label").cast("string").alias("section"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    out = retrieve.answers(hits, retrieve.Settings(min_confidence=0.4), {"1": 2, "2": 1, "3": 3}, 8)
    return out.select("qid", F.round("confidence", 6).alias("confidence"), "abstained", F.md5("context").alias("context"))


@query()
def search_by_text(spark, d):
    """Benchmark items against all documents under the stand-in embedder, re-ranked by shared words."""
    e = embedder()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), e.passages(F.col("text")).alias("embedding"), "doc_id", F.col("source").alias("title"), "text")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), e.queries(F.col("text")).alias("qv"), F.col("text").alias("query"))
    hits = retrieve.candidates(q, docs, 24, leave_out=None).withColumn("id", F.col("vec_id"))
    return rank.reranked(hits, scorer(), 8, most=None).select("qid", "vec_id", "rank", "score", "rerank_score")


# measures

@query(f"WITH {_hits_sql(10)} SELECT qid, CAST(coalesce(max(CASE WHEN label = ql THEN 1 ELSE 0 END), 0) AS INT) AS hit, round(coalesce(1 / min(CASE WHEN label = ql THEN rank END), 0), 6) AS rr FROM h GROUP BY qid")
def hit_mrr_at_k(spark, d):
    out = metrics.hit_and_rank(_labelled(spark, d, 10), F.col("label") == F.col("ql"), 10)
    return out.withColumn("rr", F.round("rr", 6))


@query(f"""WITH {_hits_sql(10)}, n AS (SELECT label AS l, COUNT(*) AS n FROM embeddings GROUP BY ALL)
SELECT qid, round(sum(CASE WHEN label = ql THEN 1 / log2(rank + 1) ELSE 0 END) / max(list_sum(list_transform(range(1, least(10, n.n - 1) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM h JOIN n ON n.l = h.ql GROUP BY qid""")
def ndcg_at_k(spark, d):
    n = _vectors(spark, d).groupBy(F.col("label").alias("ql")).agg((F.count(F.lit(1)) - 1).alias("n"))
    out = metrics.ndcg(_labelled(spark, d, 10).join(n, "ql"), F.col("label") == F.col("ql"), F.col("n"), 10)
    return out.withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH {_hits_sql(10)} SELECT qid, round(1 - COUNT(DISTINCT label) / COUNT(*), 6) AS dup_rate FROM h GROUP BY qid")
def dup_rate(spark, d):
    per = _labelled(spark, d, 10).groupBy("qid").agg(F.collect_list("label").alias("keys"))
    return per.select("qid", F.round(metrics.dup_rate(F.col("keys")), 6).alias("dup_rate"))


@query(f"""WITH {_hits_sql(10)}, p AS (SELECT qid, max(CASE WHEN label = ql THEN 1 ELSE 0 END) AS hit, coalesce(1 / min(CASE WHEN label = ql THEN rank END), 0) AS rr, 1 - COUNT(DISTINCT label) / COUNT(*) AS dup FROM h GROUP BY qid)
SELECT COUNT(*) AS n, round(avg(hit), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(dup), 6) AS dup_rate FROM p""")
def evaluation_summary(spark, d):
    hits = _labelled(spark, d, 10)
    per = hits.groupBy("qid").agg(F.max((F.col("label") == F.col("ql")).cast("int")).alias("hit"), F.coalesce(1 / F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))), F.lit(0.0)).alias("rr"), metrics.dup_rate(F.collect_list("label")).alias("dup"))
    return per.agg(F.count(F.lit(1)).alias("n"), *[F.round(metrics.mean_or_zero(a), 6).alias(b) for a, b in (("hit", "recall"), ("rr", "mrr"), ("dup", "dup_rate"))])


@query("SELECT event_type, COUNT(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", "value")
    per = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.mean_or_zero("value"), 6).alias("mean"))
    return per.join(metrics.nearest_ranks(e, "event_type", "value", {"p50": 0.5, "p95": 0.95}), "event_type")


@query("""WITH p AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id), w AS (SELECT round(a, 6) AS a, round(b, 6) AS b FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT COUNT(*) AS n, COUNT(*) FILTER (b < a) AS wins, COUNT(*) FILTER (b = a) AS ties, round((COUNT(*) FILTER (b < a) + COUNT(*) FILTER (b = a) / 2) / COUNT(*), 6) AS win_rate FROM w""")
def ab_winrate(spark, d):
    mean = lambda kind: F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6)
    per = table(spark, d, "events").groupBy("user_id").agg(mean("view").alias("a"), mean("click").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return metrics.win_rate(per, "a", "b", lower_is_better=True).withColumn("win_rate", F.round("win_rate", 6))


@query(f"""WITH {_hits_sql(10)}, p AS (SELECT qid, coalesce(1 / min(CASE WHEN label = ql THEN rank END), 0) AS rr FROM h GROUP BY qid), i AS (SELECT unnest(range(1, 2001)) AS i),
u AS (SELECT i, rr, CAST('0x' || substr(md5(qid || ':' || i || ':42'), 1, 7) AS BIGINT) / 268435456.0 AS u FROM p CROSS JOIN i),
w AS (SELECT i, rr, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253], lambda x: u >= x)) AS w FROM u),
m AS (SELECT i, sum(rr * w) / sum(w) AS m FROM w GROUP BY i) SELECT round(avg(m), 6) AS mean, round(list(m ORDER BY m)[50], 6) AS low, round(list(m ORDER BY m)[1950], 6) AS high FROM m""")
def bootstrap_ci(spark, d):
    per = metrics.hit_and_rank(_labelled(spark, d, 10), F.col("label") == F.col("ql"), 10)
    return metrics.bootstrap(per.select(F.col("qid").alias("key"), "rr"), "rr").select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


# documents

@query("SELECT md5(text) AS h, min(doc_id) AS doc_id, COUNT(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING COUNT(*) > 1")
def exact_dup_groups(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("h"), "doc_id")
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH r AS (SELECT source, lang, d.doc_id, n_chars, coalesce(quality, -1) AS quality, row_number() OVER (PARTITION BY source, lang ORDER BY coalesce(quality, -1) DESC, n_chars DESC, d.doc_id) AS n FROM documents d LEFT JOIN labels USING (doc_id))
SELECT source, lang, doc_id, n_chars, quality FROM r WHERE n = 1""")
def best_record(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))
    keyed = rows.withColumn("a", -F.col("quality")).withColumn("b", -F.col("n_chars"))
    return assemble.first_of(keyed, ["source", "lang"], ["a", "b", "doc_id"]).select("source", "lang", "doc_id", "n_chars", "quality")


LINES = r"""l AS (SELECT doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, source, lang, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS pos, unnest(ls) AS line FROM l)"""


@query(f"WITH {LINES}, g AS (SELECT line, COUNT(DISTINCT source) AS n_groups, COUNT(*) AS n FROM lines WHERE length(line) <= 80 GROUP BY line HAVING COUNT(DISTINCT source) >= 5) SELECT line, n_groups, CAST(n AS BIGINT) AS n FROM g")
def boilerplate_lines(spark, d):
    return assemble.common_lines(assemble.text_lines(table(spark, d, "documents"), "source"), "source")


@query(f"""WITH {LINES}, g AS (SELECT line FROM lines WHERE length(line) <= 80 GROUP BY line HAVING COUNT(DISTINCT source) >= 5)
SELECT doc_id, COUNT(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_kept, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM lines WHERE line NOT IN (SELECT line FROM g) GROUP BY doc_id""")
def boilerplate_strip(spark, d):
    lines = assemble.text_lines(table(spark, d, "documents"), "doc_id", "source")
    kept = lines.join(assemble.common_lines(lines, "source").select("line"), "line", "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_kept"), F.md5(joined).alias("digest"))


@query(rf"""WITH {LINES}, f AS (SELECT doc_id, pos, length(line) < 2 OR regexp_matches(line, '(?i)(https?://|www\.)[\w.\-]+\.[a-z]{{2,}}') OR regexp_matches(line, '\b0\d{{1,2}}-?\d{{3,4}}-?\d{{4}}\b') AS noise FROM lines)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (noise) AS n_noise FROM f GROUP BY doc_id""")
def noise_line_filter(spark, d):
    lines = assemble.text_lines(table(spark, d, "documents"), "doc_id")
    bad = (F.length("line") < 2) | F.col("line").rlike(noise.FAMILIES["url"].replace("가-힣", "")) | F.col("line").rlike(noise.FAMILIES["phone"])
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_noise"))


@query(r"""SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(text, '[A-Za-z]')) / length(text), 6) ELSE 1 END AS DOUBLE) AS latin_ratio,
CAST(CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN round(len(regexp_extract_all(text, '[A-Za-z]')) / len(regexp_extract_all(text, '\p{L}')), 6) ELSE 0 END AS DOUBLE) AS latin_share,
CAST(CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(text, 'https?://|www\.')) / (len(regexp_extract_all(text, ' ')) + 1), 6) ELSE 0 END AS DOUBLE) AS url_ratio FROM documents WHERE text IS NOT NULL""")
def text_ratios(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", *[F.round(f(F.col("text")), 6).alias(f.__name__) for f in (text.latin_ratio, text.latin_share, text.url_ratio)])


@query("SELECT page_id, lower(regexp_extract(url, '(?i)https?://([^/]+)', 1)) AS domain, regexp_extract(url, '^[^?#]*', 0) AS target FROM pages")
def domain_and_href(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"), text.href_target(F.col("url")).alias("target"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(translate(text, chr(8203) || chr(65279), '  '), '\s+', ' ', 'g'))) AS plain,
md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[ \t\x{00A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS visible FROM documents WHERE text IS NOT NULL""")
def normalise_text(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(text.clean_plain(F.col("text"))).alias("plain"), F.md5(text.strip_invisible(F.col("text"))).alias("visible"))


@query(r"""SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Nl}]+', '', 'g')) AS key, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS clean FROM documents""")
def search_key(spark, d):
    """The test texts have no sign that NFKC or a rule for odd blanks changes; those are left to unit tests."""
    return table(spark, d, "documents").select("doc_id", F.md5(text.search_key(F.col("text"))).alias("key"), F.md5(text.clean(F.col("text"))).alias("clean"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SHORT = r"len(list_filter(ls, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) <= 30)) / len(ls) >= 0.6"


def _clean_sql() -> str:
    """clean_chunk step by step; the last pattern for headlines looks ahead, so it goes by lines here."""
    visible = pages.visible_sql("text")
    left = pages.visible_sql(pages.deleted_sql("t0", text.LEFTOVERS))
    return rf"""a AS (SELECT doc_id, text, {visible} AS t0 FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT doc_id, text, {pages.deleted_sql("t1", text.FURNITURE)} AS t FROM (SELECT doc_id, text, {left} AS t1 FROM a)), c AS (SELECT *, regexp_split_to_array(t, '\r\n|\r|\n') AS ls FROM b),
f AS (SELECT doc_id, text, CASE WHEN t <> '' AND {_SHORT} THEN '' ELSE {_STRIP.format("t")} END AS t FROM c),
g AS (SELECT doc_id, text, array_to_string(list_transform(string_split({pages.deleted_sql("t", text.HEADLINES[:-1])}, chr(10)), lambda x: CASE WHEN length(x) BETWEEN 7 AND 400 AND NOT contains(x, '。') AND regexp_matches(x, '^.{{5,200}}?(\.\.|\.…|…\.|……)') THEN '' ELSE x END), chr(10)) AS t FROM f),
h AS (SELECT doc_id, text, array_to_string(list_filter(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: {_STRIP.format("x")} <> '' AND NOT (length({_STRIP.format("x")}) <= 120 AND len(regexp_extract_all(x, '["“”‘’''…\[\]()【】<>]')) >= 2 AND regexp_matches(x, '[…\[\]()]'))), chr(10)) AS t FROM g)"""


@query(rf"""WITH {_clean_sql()} SELECT doc_id, CAST(length({_STRIP.format("t")}) AS INT) AS cleaned, CAST(length(trim(regexp_replace({pages.deleted_sql("text", text.LICENSE_SPANS)}, '\s+', ' ', 'g'))) AS INT) AS unlicensed,
CAST(length(trim(regexp_replace(regexp_replace(text, '\[\d+\]', '', 'g'), '\s+', ' ', 'g'))) AS INT) AS uncited FROM h""")
def clean_chunks(spark, d):
    docs = table(spark, d, "documents")
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text.clean_chunk(t)).alias("cleaned"), F.length(text.without_license_spans(t)).alias("unlicensed"), F.length(text.without_citations(t)).alias("uncited"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(regexp_extract(url, '^[^?#]*', 0), '([^/]*)$', 1), '\.html$', '') AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(text.title_of_path(text.href_target(F.col("url"))), r"\.html$", "").alias("title"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((n - 1200) / 1000.0)) AS BIGINT) + 1)) AS k FROM n WHERE n > 0)
SELECT doc_id, CAST(k AS INT) AS k, md5(substring(text, k * 1000 + 1, 1200)) AS digest FROM w""")
def char_windows(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(chunk.windows(F.col("text"), 1200, 200)).alias("k", "w")).select("doc_id", "k", F.md5("w").alias("digest"))


@query()
def sentence_chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunk.sentence_chunks(F.col("text"))).alias("k", "c")).select("doc_id", "k", F.length("c").alias("n"), F.md5("c").alias("digest"))


@query()
def tail_chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunk.tail_chunks(F.col("text"))).alias("k", "c")).select("doc_id", "k", F.length("c").alias("n"), F.md5("c").alias("digest"))


@query()
def stitch_short(spark, d):
    docs = table(spark, d, "documents")
    lines = chunk.clean_lines(F.col("text"), normal_form=False)
    return docs.select("doc_id", F.posexplode(chunk.merge_small(chunk.stitch_short(lines))).alias("k", "c")).select("doc_id", "k", F.length("c").alias("n"), F.md5("c").alias("digest"))


@query(f"""WITH {LINES}, f AS (SELECT doc_id, lang, line, min(pos) AS pos FROM lines GROUP BY ALL)
SELECT doc_id, lang AS section, COUNT(*) AS n_chunks, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest FROM f GROUP BY ALL""")
def section_assemble(spark, d):
    rows = assemble.text_lines(table(spark, d, "documents"), "doc_id", "lang")
    chunks = rows.select(F.col("doc_id").alias("seed"), F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("section"), "pos", F.col("line").alias("chunk"), F.lit(None).cast("string").alias("url"))
    docs = assemble.assembled(chunks).select("seed", F.explode(F.map_entries("sections")).alias("e"))
    return docs.select(F.col("seed").alias("doc_id"), F.col("e.key").alias("section"), F.size("e.value.chunks").cast("long").alias("n_chunks"), F.md5("e.value.text").alias("digest"))


@query(rf"""WITH {LINES}, h AS (SELECT *, CASE WHEN length(line) < 40 AND NOT contains(line, '.') THEN line END AS head FROM lines),
s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h)
SELECT doc_id, section, COUNT(*) AS n, CAST(sum(pos) AS BIGINT) AS places FROM s WHERE head IS NULL GROUP BY ALL""")
def section_ffill(spark, d):
    lines = assemble.text_lines(table(spark, d, "documents"), "doc_id")
    head = F.when((F.length("line") < 40) & ~F.contains("line", F.lit(".")), F.col("line"))
    return assemble.with_sections(lines, head).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


@query("SELECT source, lang, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang ORDER BY n DESC, source, lang LIMIT 20")
def category_counts(spark, d):
    per = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return per.orderBy(F.col("n").desc(), "source", "lang").limit(20)


@query("""WITH m AS (SELECT d.doc_id, n_chars AS body_len, CASE WHEN quality = 1 THEN n_chars // 10 ELSE 0 END AS summary_len, CASE WHEN toxic = 1 THEN 3 ELSE 5 END AS n_bullets FROM documents d LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN summary_len = 0 THEN 'no_summary' END, CASE WHEN summary_len BETWEEN 1 AND 119 THEN 'short_summary' END, CASE WHEN n_bullets <> 5 THEN 'bullets' END], lambda x: x IS NOT NULL), ',') AS reason FROM m WHERE NOT (body_len > 0 AND body_len < 300))
SELECT doc_id, body_len, summary_len, CAST(n_bullets AS INT) AS n_bullets, reason FROM r WHERE reason <> ''""")
def resummarise_targets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("body_len")).join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", "body_len", F.when(F.col("quality") == 1, F.expr("body_len div 10")).otherwise(0).cast("long").alias("summary_len"), F.when(F.col("toxic") == 1, 3).otherwise(5).alias("n_bullets"))
    return assemble.summary_targets(rows)


_SENTENCES = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT doc_id, {_SENTENCES.format("substring(coalesce(text, ''), 1, 3000)")} AS s FROM documents) SELECT doc_id, CASE WHEN len(s) > 0 THEN substring(s[1], 1, 280) END AS summary, CAST(len(s[1:3]) AS INT) AS n_bullets, 'first-sentences' AS model FROM p""")
def summaries(spark, d):
    s = summarised(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.summary", F.size("s.bullets").alias("n_bullets"), "s.model")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || '|' || json_extract_string(props, '$.k') AS flat FROM events")
def meta_flatten(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    rows = table(spark, d, "events").select("event_id", k.alias("k"), F.array("event_type", k.cast("string")).alias("parts"))
    return rows.select("event_id", "k", assemble.scalar_metadata(F.col("parts"), rows.schema["parts"].dataType).alias("flat"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 4) AS o_totalprice FROM orders""")
def upsert_merge(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1)
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), price.alias("o_totalprice"))
    return upsert.merged(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 2 = 0)
SELECT o_custkey, o_orderkey, CASE WHEN c IS NULL THEN 'v1' ELSE 'v2' END AS version FROM orders LEFT JOIN n ON c = o_custkey WHERE c IS NULL OR o_orderkey % 2 = 0""")
def replace_chunks(spark, d):
    old = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lit("v1").alias("version"))
    new = old.where("o_custkey % 4 = 0 AND o_orderkey % 2 = 0").withColumn("version", F.lit("v2"))
    return upsert.replaced(old, new, "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_wins(spark, d):
    return upsert.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT c.c_custkey, COUNT(o_orderkey) AS n_items, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), '|'), '') AS items FROM customer c LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_attach(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = assemble.attached(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderkey"), "items")
    return out.select("c_custkey", F.size("items").cast("long").alias("n_items"), F.array_join("items", "|").alias("items"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey - 1, 'ADDED' FROM customer WHERE c_custkey % 100 = 0")
def coalesce_update(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("UPDATED"))
    new = new.unionByName(old.where("c_custkey % 100 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment")))
    return assemble.updated(old, new, ["c_custkey"], ["c_mktsegment"])


@query("SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1")
def last_user_message(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return upsert.latest(rows, ["conv_id"], "turn").select("conv_id", "turn", F.trim("text").alias("text"))


@query("SELECT d.doc_id AS id, b.item_id AS phrase_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def alias_contains_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return assemble.containing(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")))


@query("SELECT source, doc_id, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def char_by_group_topn(spark, d):
    return assemble.longest_of(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", F.col("n_chars"), 5, "doc_id")


@query("""SELECT doc_id, substring(md5(source), 1, 24) AS seed_id, md5(source || '||' || lang) AS title_id, substring(sha1(source), 1, 24) AS work_id, sha1(source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)) AS record_id,
substring(md5(source || '|' || lang || '|1|' || text), 1, 24) || '_1' AS passage_id, substring(md5(source || '#2::' || text), 1, 24) || '_2' AS page_chunk_id, CAST(doc_id AS VARCHAR) || '#b' || lpad(CAST(n_chars % 1000 AS VARCHAR), 4, '0') AS block_id,
CAST(doc_id AS VARCHAR) || ':7' AS segment_id, 'p|' || CAST(doc_id AS VARCHAR) || '|' || lang || '%20x|3' AS vector_id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL""")
def stable_ids(spark, d):
    x = F.col
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    return docs.select("doc_id", ids.seed_id(x("source")).alias("seed_id"), ids.title_id(x("source"), x("lang")).alias("title_id"), ids.work_id(x("source")).alias("work_id"), ids.record_id(x("source"), x("lang"), x("doc_id")).alias("record_id"), ids.passage_id(x("source"), x("lang"), F.lit(1), x("text")).alias("passage_id"), ids.page_chunk_id(x("source"), F.lit(2), x("text")).alias("page_chunk_id"), ids.block_id(x("doc_id"), (x("n_chars") % 1000)).alias("block_id"), ids.segment_id(x("doc_id"), F.lit(7)).alias("segment_id"), ids.vector_id(x("doc_id"), F.concat(x("lang"), F.lit(" x")), F.lit(3), "p").alias("vector_id"))


@query("SELECT COUNT(text) AS n_texts, CAST(min(length(text)) AS INT) AS least, CAST(quantile_disc(length(text), 0.5) AS INT) AS median, round(avg(length(text)), 6) AS mean, CAST(max(length(text)) AS INT) AS most FROM documents")
def length_stats(spark, d):
    return length_statistics(table(spark, d, "documents")).withColumn("mean", F.round("mean", 6))


@query("SELECT COUNT(*) AS total, COUNT(*) FILTER (quality = 1) AS kept, COUNT(*) FILTER (quality = 0) AS removed, COUNT(*) FILTER (quality = 0 AND toxic = 0) AS rescued, round(100.0 * COUNT(*) FILTER (quality = 1) / COUNT(*), 4) AS percent FROM labels")
def coverage_stats(spark, d):
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    return table(spark, d, "labels").agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("kept"), F.count_if(bad).alias("removed"), F.count_if(bad & (F.col("toxic") == 0)).alias("rescued"), F.round(100.0 * F.count_if(good) / F.count(F.lit(1)), 4).alias("percent"))


@query("SELECT doc_id, CAST(CASE WHEN n_chars > 0 AND n_chars // 3 > 0 THEN round((n_chars // 3) / n_chars, 4) END AS DOUBLE) AS ratio FROM documents")
def compression_ratio(spark, d):
    part = F.expr("n_chars div 3")
    return table(spark, d, "documents").select("doc_id", F.when((F.col("n_chars") > 0) & (part > 0), F.round(part / F.col("n_chars"), 4)).alias("ratio"))


@query("SELECT DISTINCT role, COUNT(*) AS n FROM (SELECT role FROM conversations UNION ALL SELECT 'seed:' || source FROM documents) GROUP BY role")
def key_union(spark, d):
    keys = table(spark, d, "conversations").select("role").unionByName(table(spark, d, "documents").select(F.concat(F.lit("seed:"), "source").alias("role")))
    return keys.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query()
def html_text(spark, d):
    p = html.parsed(F.col("html"))
    return table(spark, d, "pages").select("page_id", "url", p.alias("p")).select("page_id", F.md5("p.text").alias("text_md5"), F.length("p.text").alias("n"), F.length("p.best").alias("best"), F.size("p.links").alias("n_links"), html.page_kind(F.col("url"), F.col("p.headings")).alias("kind"))


_LINKS = r"""e AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+') || h AS target, t AS text FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t FROM pages))"""


@query(f"WITH {_LINKS} SELECT DISTINCT page_id, target, trim(text) AS text FROM e")
def child_links(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", html.parsed(F.col("html")).alias("p"))
    links = pages.select("page_id", "url", F.explode("p.links").alias("l"))
    return links.select("page_id", html.absolute(F.col("url"), F.col("l.href")).alias("target"), F.col("l.text").alias("text")).distinct()


@query(f"""WITH {_LINKS}, s AS (SELECT DISTINCT url FROM pages WHERE page_id % 20 = 0), a AS (SELECT DISTINCT target AS url FROM e WHERE url IN (SELECT url FROM s) AND target NOT IN (SELECT url FROM s)),
b AS (SELECT DISTINCT target AS url FROM e WHERE url IN (SELECT url FROM a) AND target NOT IN (SELECT url FROM s UNION ALL SELECT url FROM a))
SELECT url, 0 AS depth FROM s UNION ALL SELECT url, 1 FROM a UNION ALL SELECT url, 2 FROM b""")
def crawl_depths(spark, d):
    """Links two steps from the pages whose id is divisible by 20, over the link graph of all pages; each page at its least depth."""
    pages = table(spark, d, "pages").select("page_id", "url", html.parsed(F.col("html")).alias("p"))
    edges = pages.select(F.col("url").alias("src"), F.explode("p.links").alias("l")).select("src", html.absolute(F.col("src"), F.col("l.href")).alias("dst")).distinct()
    return crawl.reached(table(spark, d, "pages").where("page_id % 20 = 0"), edges)


@query()
def fake_embed(spark, d):
    e = embedder()
    v = table(spark, d, "documents").select("doc_id", e.passages(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(vector.norm(F.col("v")), 4).alias("norm"), F.round(F.element_at("v", 1), 5).alias("first"))


@query("""SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm,
round(greatest(0.0, least(1.0, 1 - list_sum(CAST(embedding AS DOUBLE[])) / 2)), 4) AS cosine_score, round(greatest(0.0, least(1.0, 1 / (1 + abs(list_sum(CAST(embedding AS DOUBLE[])))))), 4) AS l2_score,
round(1 / (1 + exp(-list_sum(CAST(embedding AS DOUBLE[])))), 4) AS ip_score, round(greatest(0.0, least(1.0, 1 - list_sum(CAST(embedding AS DOUBLE[])))), 4) AS plain_score FROM embeddings""")
def score_conversion(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    v = _vectors(spark, d).select("vec_id", "embedding", total.alias("t"))
    t: Column = F.col("t")
    return v.select("vec_id", F.round(vector.norm(F.col("embedding")), 4).alias("norm"), F.round(vector.similarity(t), 4).alias("cosine_score"), F.round(vector.similarity(F.abs(t), "l2"), 4).alias("l2_score"), F.round(vector.similarity(t, "ip"), 4).alias("ip_score"), F.round(vector.plain_similarity(t), 4).alias("plain_score"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def repeated_keys(spark, d):
    return upsert.repeated_keys(table(spark, d, "orders"), ["o_custkey"])


@query("SELECT event_type, date_trunc('hour', ts) AS start, COUNT(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    """The batch form of the streaming count."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
