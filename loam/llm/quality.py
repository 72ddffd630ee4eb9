"""Quality classifier: a factorisation machine over hashed words and structure of whole texts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table, written

#: Hashed words, bins of each statistic, and factors of the pairwise weights.
HASHED, BINS, FACTORS = 1 << 15, 10, 8
#: Labelled rows that a model is fitted on at most, those of least md5 of the id: what the driver holds is bounded by it.
SAMPLE = 6000
#: Passes over the sample, and batches at least, which make more passes of a small one.
EPOCHS, UPDATES, BATCH, RATE, DECAY = 12, 600, 64, 0.05, 1e-5
STATISTICS = 16

_lower, _upper, _digit, _space = (np.zeros(256, bool) for _ in range(4))
_lower[97:123] = _lower[128:] = True
_upper[65:91] = True
_digit[48:58] = True
_space[[9, 10, 11, 12, 13, 32]] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in ".,;:?'\"-()"]] = True
_other = ~(_lower | _upper | _digit | _space | _mark)
CLASSES = np.stack([_lower, _upper, _digit, _space, _mark, _other]).astype(np.int64)


def features(text: str, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of a whole text, their weights (of length 1 together), its statistics, and those of its metadata: the
    length that its row states (null or none: the text's own), and by how much it is another than the text's."""
    words = Counter(text.split())
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    per = CLASSES @ np.bincount(raw, minlength=256)
    n, tokens = max(len(raw), 1), max(words.total(), 1)
    lines = [x for x in text.split("\n") if x]
    bars = text.count("|") + text.count("#") + text.count("!")
    top = max(words.values(), default=0)
    capital = sum(c for w, c in words.items() if w.isupper() and len(w) > 1)
    odd = sum(c for w, c in words.items() if not w[-1].isalnum() and w[-1] not in ".,;:?!)\"'")
    stats = [np.log1p(len(raw)), np.log1p(tokens), *(per / n), bars / tokens, len(words) / tokens, len(set(lines)) / max(len(lines), 1), top / tokens, capital / tokens, odd / tokens]
    stated = len(text) if n_chars is None else max(int(n_chars), 0)
    stats += [np.log1p(stated), abs(np.log1p(stated) - np.log1p(len(text)))]
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.array(stats)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.int64, len(words)) % HASHED
    x = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    return at.astype(np.int32), (x / np.sqrt((x * x).sum())).astype(np.float32), np.array(stats)


class Model:
    """bias + w.x + sum over pairs of <v_i, v_j> x_i x_j; features are hashed words, then a bin of each statistic."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 4):
        stats = np.array([r[2] for r in rows]).reshape(-1, STATISTICS)
        inner = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = np.quantile(stats, inner, axis=0).T if len(rows) else np.zeros((STATISTICS, BINS - 1))
        size = HASHED + STATISTICS * BINS
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.01, (size, FACTORS)).astype(np.float32)
        if len(set(labels.tolist())) == 2:
            self._fit([self._join(*r) for r in rows], labels.astype(np.float64), rng)
        else:
            self.v[:] = 0

    def _join(self, at: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (self.edges <= stats[:, None]).sum(axis=1) + np.arange(STATISTICS) * BINS + HASHED
        return np.r_[at, bins], np.r_[x, np.full(STATISTICS, STATISTICS**-0.5, np.float32)]

    def _fit(self, rows: list, labels: np.ndarray, rng: np.random.Generator) -> None:
        self.bias = float(np.log(labels.mean() / (1 - labels.mean())))
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        epochs = max(EPOCHS, -(-UPDATES * BATCH // len(rows)))
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            rate = RATE / (1 + 3 * epoch / epochs)
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                cols = np.concatenate([rows[i][0] for i in some])
                x = np.concatenate([rows[i][1] for i in some])
                sizes = np.array([len(rows[i][0]) for i in some])
                starts = np.cumsum(sizes) - sizes
                vx = self.v[cols] * x[:, None]
                total = np.add.reduceat(vx, starts)
                z = self.bias + np.add.reduceat(self.w[cols] * x, starts) + 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
                d = np.repeat((1 / (1 + np.exp(-z)) - labels[some]) / len(some), sizes)
                used, inverse = np.unique(cols, return_inverse=True)
                dw = np.bincount(inverse, d * x, len(used)) + DECAY * self.w[used]
                each = (d * x)[:, None] * (np.repeat(total, sizes, axis=0) - vx)
                dv = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                db = float(d[starts].sum())
                gb += db * db
                self.bias -= rate * db / gb**0.5

    def score(self, text: str, n_chars: int | None = None) -> float:
        """In time linear in the features: the pairs' sum is half of the squared sum less the sum of squares."""
        cols, x = self._join(*features(text, n_chars))
        vx = self.v[cols] * x[:, None]
        z = self.bias + float(self.w[cols] @ x) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx * vx).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows whose crc32(doc_id) mod 3 isn't 1, of least md5 of the id.

    Their features, not their texts, come to the driver. Labels that are null or repeat an id (the least counts) or have
    no document are left out; of documents that repeat an id the one of least text hash counts, so no more than `sample` rows
    come; null texts are empty, long ones count whole; without labels of both kinds every score is that of the bias, 0.5.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(remainder(F.col("doc_id")) != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # at most `sample` pairs of numbers: a bound that doesn't depend on the data
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"), stated(docs).alias("n_chars"))
    rows = docs.join(F.broadcast(written(known)), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "text", "n_chars")).alias("m")).select("doc_id", "quality", "m.text", "m.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py(), n.as_py()) for t, n in zip(b.column("text"), b.column("n_chars"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float32())), pa.array([f[2].tolist() for f in found], pa.list_(pa.float64()))], names=["doc_id", "quality", "at", "x", "stats"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    got = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, at array<int>, x array<float>, stats array<double>")
    got = got.orderBy("doc_id").toArrow()
    offsets = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got.column("at"), got.column("x"), got.column("stats"))]
    rows_ = [tuple(o[i].values.to_numpy(zero_copy_only=False) for o in offsets) for i in range(got.num_rows)]
    return Model(rows_, np.array(got.column("quality").to_pylist(), int))


def stated(docs: DataFrame) -> F.Column:
    """The length that a row states, if it does."""
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """_row, docs' columns in a struct, and _score, the model's score of each whole text; a null text is empty."""
    boxed = docs.select(F.struct("*").alias("_row"), stated(docs).alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(t.as_py() or "", n.as_py()) for t, n in zip(b.column(0).field("text"), b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["_row", "_score"])

    return boxed.mapInArrow(run, T.StructType([boxed.schema["_row"], T.StructField("_score", T.DoubleType())]))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs (with a column text) and the model's score of each whole text, in a column that replaces one of its name."""
    return with_scores(docs.drop(name), model).select("_row.*", F.col("_score").alias(name))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with doc_id, held_out, score and predicted.

    Null and empty texts are scored by their statistics; long ones count whole; repeated rows have one score; a null doc_id
    isn't held out; columns other than doc_id, text and n_chars are left; an empty table gives no rows, and without labels
    of both kinds every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", stated(docs).alias("n_chars"))
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a model fitted on them and the labels of sf_dir rejects (score under 0.5), all their columns as
    they are, whatever their names.

    Null, empty and long texts, repeated rows, missing labels and an empty docs as in op4_quality; a tie at 0.5 stays.
    """
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return with_scores(docs, model).where(F.col("_score") >= 0.5).select("_row.*")
