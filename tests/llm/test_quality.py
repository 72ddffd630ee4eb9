import zlib

import numpy as np

from loam.llm import quality as Q
from loam.llm.quality import Model, features, fitted, op4_quality, quality_stage, scored

DIR = "/root/testdata/sf0.01"


def naive(model, text):
    cols, x = model._join(*features(text))
    z = model.bias + sum(model.w[c] * v for c, v in zip(cols, x))
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            z += float(model.v[cols[i]] @ model.v[cols[j]]) * float(x[i] * x[j])
    return 1 / (1 + np.exp(-z))


def test_linear_time_identity():
    rows = [features(t) for t in ("a plain text of words", "JUNK!! JUNK!! ###", "more words here", "|| x || y ||")]
    model = Model(rows, np.array([1, 0, 1, 0]))
    for t in ("a plain text of words", "JUNK!! a", "", "x " * 50):
        assert abs(model.score(t) - naive(model, t)) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels)).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    out = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(out) > 80 and np.mean([(r["score"] >= 0.5) == r["quality"] for r in out]) > 0.95


def test_other_columns_play_no_part(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    model = fitted(docs, labels)
    rows = [(1, "some text", "en", "src0"), (2, "some text", None, None)]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()
    assert got[0]["score"] == got[1]["score"]
    held = labels.where(Q.remainder(labels["doc_id"]) == 1)
    flipped = labels.where(Q.remainder(labels["doc_id"]) != 1).unionByName(held.selectExpr("doc_id", "1 - quality AS quality", "toxic"))
    assert fitted(docs, flipped).score("some text") == model.score("some text")


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(None, None, 3.0), (1, "", 3.0), (1, "word " * 100_000, None), (2, "�\n", 1.0)], "doc_id long, text string, score double")
    model = fitted(docs, empty)
    out = scored(docs, model).collect()
    assert [r["score"] for r in out] == [0.5] * 4 and len(out[0]) == 3  # a column named score is replaced
    assert scored(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 0), (99, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert 0 <= fitted(docs, labels).score("x") <= 1


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = quality_stage(spark, docs, DIR)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert out.columns == docs.columns
    kept = out.join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r["quality"]: r["count"] for r in kept}
    all_ = {r["quality"]: r["count"] for r in docs.join(labels, "doc_id").groupBy("quality").count().collect()}
    assert kept[1] >= 0.98 * all_[1] and kept.get(0, 0) <= 0.1 * all_[0]


def plain_training(rows, labels, seed=4):
    """The same descent with loops over rows, features and all pairs of them."""
    blank = Model(rows, np.zeros(len(rows)))
    data = [tuple(map(list, blank._join(*r))) for r in rows]
    rng = np.random.default_rng(seed)
    v = {c: x.astype(np.float64) for c, x in enumerate(rng.normal(0, 0.01, (Q.HASHED + Q.STATISTICS * Q.BINS, Q.FACTORS)).astype(np.float32))}
    w, gw, gv, gb = {}, {}, {}, 1e-6
    bias = float(np.log(np.mean(labels) / (1 - np.mean(labels))))
    epochs = max(Q.EPOCHS, -(-Q.UPDATES * Q.BATCH // len(rows)))
    for epoch in range(epochs):
        order, rate = rng.permutation(len(rows)), Q.RATE / (1 + 3 * epoch / epochs)
        for k in range(0, len(order), Q.BATCH):
            some, dw, dv, db = order[k : k + Q.BATCH], {}, {}, 0.0
            for i in some:
                cols, x = data[i]
                z = bias + sum(w.get(c, 0) * a for c, a in zip(cols, x))
                z += sum(x[a] * x[b] * float(v[cols[a]] @ v[cols[b]]) for a in range(len(cols)) for b in range(a))
                d = (1 / (1 + np.exp(-z)) - labels[i]) / len(some)
                db += d
                for a, c in enumerate(cols):
                    dw[c] = dw.get(c, 0) + d * x[a]
                    dv[c] = dv.get(c, 0) + d * x[a] * sum((x[b] * v[cols[b]] for b in range(len(cols)) if b != a), np.zeros(Q.FACTORS))
            for c in dw:
                a, b = dw[c] + Q.DECAY * w.get(c, 0), dv[c] + Q.DECAY * v[c]
                gw[c], gv[c] = gw.get(c, 1e-6) + a * a, gv.get(c, 1e-6) + b * b
                w[c], v[c] = w.get(c, 0) - rate * a / gw[c] ** 0.5, v[c] - rate * b / np.sqrt(gv[c])
            gb += db * db
            bias -= rate * db / gb**0.5
    return bias, w, v


def test_training_against_a_plain_version(monkeypatch):
    for name, value in (("EPOCHS", 2), ("UPDATES", 4), ("BATCH", 4), ("FACTORS", 3)):
        monkeypatch.setattr(Q, name, value)
    rows = [features(t, n) for t, n in (("good words of prose here", None), ("JUNK!! JUNK!! ###", 3), ("more good words", None), ("|| x || y ||", 90), ("prose of words", None), ("## buy ##", None), ("", None))]
    labels = np.array([1, 0, 1, 0, 1, 0, 0])
    model = Model(rows, labels)
    bias, w, v = plain_training(rows, labels)
    assert abs(model.bias - bias) < 1e-4
    assert max(abs(model.w[c] - x) for c, x in w.items()) < 1e-4
    assert max(np.abs(model.v[c] - v[c]).max() for c in w) < 1e-3


def test_query(spark):
    found = op4_quality(spark, DIR)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    model = fitted(docs, labels)
    want = {r["doc_id"]: model.score(r["text"] or "", r["n_chars"]) for r in docs.collect()}
    got = {r["doc_id"]: r for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[i]["score"] - s) < 1e-12 for i, s in want.items())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


def test_a_repeated_id_brings_one_row(spark):
    docs = spark.createDataFrame([(2, f"text {k}") for k in range(50)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []

    class Spy(Model):
        def __init__(self, rows, labels):
            seen.append(len(rows))
            super().__init__(rows, labels)

    old, Q.Model = Q.Model, Spy
    try:
        fitted(docs, labels)
    finally:
        Q.Model = old
    assert seen[0] <= 2


def test_stage_with_clashing_names(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(50).selectExpr("*", "doc_id AS _row", "'s' AS _score", "1 AS _quality_score", "2 AS _n")
    out = quality_stage(spark, docs, DIR)
    assert out.columns == docs.columns and {(r["_row"], r["_score"], r["_quality_score"]) for r in out.collect()} <= {(r["doc_id"], "s", 1) for r in docs.collect()}
