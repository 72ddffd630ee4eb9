"""Digests of improbable features: byte windows of rare entropy in chained Bloom filters, compared by shared bits."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Bytes of a feature, neighbours among which the rarest is chosen, and how often it must be.
WIDTH, NEIGHBOURS, POPULAR = 32, 32, 8
#: Bits and features of a filter, and bits a feature sets in it.
FILTER_BITS, FEATURES, HASHES = 2048, 160, 5
#: Entropy of a window of plain prose, its spread, and the least below which a window is taken only for want of others.
TYPICAL, SPREAD, LOW = 3.5, 0.23, 2.0
SLICE, UNIT = 1 << 17, 1024
#: Rows sampled a part, about, to find the bounds of parts.
SAMPLED = 50
SHIFTS = np.arange(HASHES, dtype=np.uint64) * np.uint64(11)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    c = np.arange(1, WIDTH + 1)
    g = np.r_[0, np.rint(UNIT * c * np.log2(c))].astype(np.int32)
    entropy = np.log2(WIDTH) - (np.arange((g[-1] >> 9) + 1) * 512 + 256) / (WIDTH * UNIT)
    # a level of entropy is rarer the further it is from what prose has; windows of very low entropy say little
    far = np.where(entropy < LOW, -1.0, np.abs(entropy - TYPICAL) / SPREAD)
    rank = np.empty(len(far), np.uint32)
    rank[np.argsort(-far, kind="stable")] = np.arange(len(far))
    return np.diff(g), rank


STEPS, RANK = _tables()
NONE = np.uint32(0xFFFFFFFF)


def rarity(buf: np.ndarray) -> np.ndarray:
    """Rank (0: rarest) of every WIDTH-byte window of buf by its entropy, which is carried on from byte to byte."""
    total = len(buf) - WIDTH + 1
    out = np.empty(total, np.uint32)
    carry = 0
    for a in range(0, total, SLICE):
        b = min(a + SLICE, total)
        low = max(a - WIDTH, 0)
        part = buf[low : b + WIDTH - 1]
        before, after = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for s in range(1, WIDTH):
            same = (part[s:] == part[:-s]).view(np.uint8)
            before[s:] += same
            after[:-s] += same
        add, drop = STEPS[before], STEPS[after]
        if a == 0:
            moved = np.r_[add[:WIDTH].sum(), add[WIDTH : b + WIDTH - 1] - drop[: b - 1]]
        else:
            k = a - low
            moved = add[k + WIDTH - 1 : b - low + WIDTH - 1] - drop[k - 1 : b - low - 1]
        s = np.cumsum(moved, dtype=np.int64) + carry
        carry = int(s[-1])
        out[a:b] = RANK[s >> 9]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def feature_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each window of WIDTH bytes."""
    word = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, 0, (1,))
    out = np.zeros(len(at), np.uint64)
    for k in range(0, WIDTH, 8):
        out = mixed(out ^ word[at + k]) + np.uint64(k)
    return out


def least_of_runs(buf: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are least in some of the runs of NEIGHBOURS positions, and of how many runs in a row they are.

    Positions compare by key, then by a hash of the bytes there, then the leftmost is less; runs of NONE alone have none.
    """
    word = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, 0, (1,))
    found, last = [], (-1, 0)
    for a in range(0, len(key) - NEIGHBOURS + 1, SLICE):
        b = min(a + SLICE + NEIGHBOURS - 1, len(key))
        part = np.minimum(key[a:b], np.uint32(0xFFFFFF)).astype(np.uint64) << np.uint64(40)
        part |= word[a:b] * ODD >> np.uint64(42) << np.uint64(18) | np.arange(b - a, dtype=np.uint64)
        for s in (1, 2, 4, 8, 16):
            part = np.minimum(part[:-s], part[s:])
        at = (part & np.uint64(0x3FFFF)).astype(np.int64) + a
        at = at[part >> np.uint64(40) != np.uint64(0xFFFFFF)]
        if len(at):
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            count = np.diff(np.r_[new, len(at)])
            at = at[new]
            if at[0] == last[0]:
                count[0] += last[1]
            elif last[0] >= 0:
                found.append((np.array([last[0]]), np.array([last[1]])))
            found.append((at[:-1], count[:-1]))
            last = (int(at[-1]), int(count[-1]))
    if last[0] >= 0:
        found.append((np.array([last[0]]), np.array([last[1]])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def chosen(buf: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features: positions, and hashes of the windows there, that are least in at least POPULAR runs.

    Equal windows that are least one after the other, as in a stretch that repeats, count together and are one feature.
    """
    at, count = least_of_runs(buf, key)
    hashes = feature_hashes(buf, at)
    if not len(at):
        return at, hashes
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (np.diff(at) > NEIGHBOURS)])
    popular = first[np.add.reduceat(count, first) >= POPULAR]
    return at[popular], hashes[popular]


def filters_of(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, a row each, of a text's features in their order; one that repeats counts once."""
    if len(hashes):
        _, first = np.unique(hashes, return_index=True)
        hashes = hashes[np.sort(first)]
    rows = -(-len(hashes) // FEATURES)
    bits = np.zeros((rows, FILTER_BITS), np.uint8)
    of = np.arange(len(hashes)) // FEATURES
    bits[of[:, None], (hashes[:, None] >> SHIFTS) & np.uint64(FILTER_BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Filters of each text. A text of under WIDTH bytes is one feature as a whole; an empty one has none."""
    gap = np.full(WIDTH, 0xFF, np.uint8).tobytes()  # no byte of UTF-8, so no window's counts reach from text to text
    buf = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths + WIDTH) - lengths
    key = rarity(buf)
    valid = np.zeros(len(key) + 1, np.int32)
    long = lengths >= WIDTH
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, (begin + lengths - WIDTH + 1)[long], -1)
    key[np.cumsum(valid[:-1]) == 0] = NONE
    at, hashes = chosen(buf, key)
    cuts = np.searchsorted(at, begin)
    ends = np.searchsorted(at, begin + lengths)
    whole = [np.frombuffer(hashlib.sha256(t).digest()[:8] if t else b"", np.uint64) if not x else None for t, x in zip(texts, long)]
    return [filters_of(hashes[cuts[k] : ends[k]] if w is None else w) for k, w in enumerate(whole)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best share of bits in common beyond chance, on average by features."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    ones = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for k, row in enumerate(x):
        both = np.bitwise_count(row & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones[0][k], ones[1])
        chance = ones[0][k] * ones[1] / FILTER_BITS
        score = np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 1.0)
        total += max(0.0, float(score.max())) * float(ones[0][k])
    return min(1.0, total / float(ones[0].sum()))


def written_out(filters: np.ndarray) -> str:
    return ",".join(base64.b64encode(f.tobytes()).decode() for f in filters)


def bounds_of(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """At most parts - 1 triples (key, h, r) that cut the rows, sorted by them, into parts of about as many bytes.

    They come from a sample of about SAMPLED rows a part, drawn in proportion to their bytes, whatever the size of the table.
    """
    weight = F.col("n") + 64
    total = rows.agg(F.sum(weight)).first()[0]
    if parts < 2 or not total:
        return []
    share = weight * (SAMPLED * parts / total)
    drawn = rows.select("key", "h", "r", share.alias("w")).where(F.rand(9) < F.col("w")).select("key", "h", "r", F.greatest("w", F.lit(1.0)))
    sample = sorted(tuple(r) for r in drawn.collect())
    filled = np.cumsum([w for *_, w in sample])
    places = np.searchsorted(filled, filled[-1] * np.arange(1, parts) / parts) if sample else []
    return sorted({sample[k][:3] for k in places})


def part_of(bounds: list[tuple[int, int, int]]):
    """A function of columns (key, h, r): how many bounds aren't above them."""
    keys = np.array([b[0] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series, h: pd.Series, r: pd.Series) -> pd.Series:
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for i in np.flatnonzero(low < high):  # rows of a bound's own key
            low[i] = bisect.bisect_right(bounds, (key.iloc[i], h.iloc[i], r.iloc[i]))
        return pd.Series(low).astype("int32")

    return part


def with_neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) partitioned by `part`, in each sorted by (part, head, key, h), so that a row's successor follows it.

    Rows ascend by doc_id (key; null is last), those of equal id by h, a hash of their text; rows equal in both are alike,
    and a random r lets parts divide even them. Each part also holds, as a row with head set, the first row of the part after
    it (of the first part for the last). One least row a part passes through the driver, without its text; texts are moved once.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.xxhash64(text).alias("h"))
    keyed = docs.withColumn("r", F.floor(F.rand(5) * (1 << 30)).cast("long"))
    bounds = bounds_of(keyed.select("key", "h", "r", F.octet_length("text").alias("n")), parts)
    place = keyed.withColumn("part", part_of(bounds)("key", "h", "r") if bounds else F.lit(0))
    least = sorted((r["part"], *r["m"]) for r in place.groupBy("part").agg(F.min(F.struct("key", "h")).alias("m")).collect())
    heads = [(k, h, least[i - 1][0]) for i, (_, k, h) in enumerate(least)]
    heads = docs.sparkSession.createDataFrame(heads, "key long, h long, part int")
    more = docs.join(F.broadcast(heads), ["key", "h"]).groupBy("part", "key", "h").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    names = ["doc_id", "text", "key", "h", "part"]
    both = place.select(*names, F.lit(False).alias("head")).unionByName(more.select(*names, F.lit(True).alias("head")))
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "head", "key", "h")


def fingerprinted(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of rows (doc_id, text).

    A fingerprint is a chain of Bloom filters in base64. The edited text has its last half (by code points, rounded
    down) replaced by the first as many of the next document's; after the last comes the first. Ids ascend, a null id is
    last, rows of equal id go by a hash of their text (xxhash64), repeated rows follow each other. Null texts are empty: no
    filter, like only what has none either. Texts of any length are read whole, each within one task. A single document is
    its own successor. Other columns, whatever their names, are left. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def solve(group: list[tuple]) -> pa.RecordBatch:
        """Of rows in their order, all but the last."""
        own = [t for _, t in group]
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(own, own[1:])]
        raw = [t.encode() for t in own]
        raw_edited = [t.encode() for t in edited]
        marks = digests(raw + raw_edited)
        mine, theirs = marks[: len(own)], marks[len(own) :]
        n = len(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in group[:n]], group_type),
                pa.array([len(t) for t in own[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw_edited]),
                pa.array([written_out(f) for f in mine[:n]]),
                pa.array([written_out(f) for f in theirs]),
                pa.array([likeness(a, b) for a, b in zip(mine, theirs)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(mine, mine[1:])], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    group_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}.get(kind, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, closed = 0, None, False
        for batch in batches:
            ids, texts, of, heads = (batch.column(c) for c in ("doc_id", "text", "part", "head"))
            for k in range(batch.num_rows):
                p = of[k].as_py()
                if p != part:
                    held, size, part, closed = [], 0, p, False
                if closed:
                    continue
                text = texts[k].as_py()
                held.append((ids[k].as_py(), text))
                size += len(text)
                closed = heads[k].as_py()
                if closed or size > 1_000_000:
                    if len(held) > 1:
                        yield solve(held)
                    held, size = held[-1:], len(text)

    return with_neighbours(docs, parts).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprints, those of their edited texts, and both likenesses, as fingerprinted has it.

    Null and empty texts have an empty fingerprint; texts of any length are read whole; ties of doc_id go by the text's
    hash; repeated rows are fingerprinted each; other columns are left; an empty table gives no rows.
    """
    return fingerprinted(table(spark, sf_dir, "documents"))
