"""Harmonic packing of token sequences."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

CAPACITY = 2048
END = 1
#: Rests under this many tokens aren't cut further.
SHORT = 64
#: White space as the tokenizer's pattern sees it, in runs so long that they are kept from the pattern: its matcher gives up on a million.
LONG = 100_000
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Coder:
    """The byte-level BPE of a tokenizer file, with its added tokens: ids are those that `tokenizers` gives for the file.

    Its merges are in the order of their ids, so the vocabulary is all that the faster library needs.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        byte = _byte_of()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in found["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in found["added_tokens"]}
        for t in self.added:
            ranks.pop(t.encode(), None)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bpe = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Ids of a text of any length. An added token's string is that token; what lies between them is encoded by itself."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [self.added[part]] if k % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        """The pattern takes a run of white space as one piece, but for its last sign where a text goes on behind it; a long
        run goes to the merges as that piece, as the matcher would keep a place on its stack for each of its signs."""
        if len(text) < LONG:
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.bpe.encode_ordinary(text[at : run.start()])
            out += self.bpe._encode_single_piece(text[run.start() : end])
            at = end
        return out + self.bpe.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def encoder(path: str) -> Coder:
    return Coder(path)


def cuts(n: int, capacity: int = CAPACITY, short: int = SHORT) -> list[int]:
    """Lengths of the pieces of n tokens: full sequences, then lengths floor(capacity / k), each exactly a k-th.

    A rest r with floor(capacity / r) = k that isn't a k-th itself gives the next smaller one, a (k+1)-th, so the rest
    falls quadratically; one under `short` stays whole and fills its class's bins nearly as well.
    """
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        take = r if r < short or r == capacity // k else capacity // (k + 1)
        out.append(take)
        r -= take
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and part, k, at: the piece's place in its class in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        shapes = [tuple(cuts(r, capacity)) for r in range(capacity)]
        for batch in batches:
            rows, counts, total = [], [], []
            for text in batch.column(1):
                ids = np.array([*coder.ids(text.as_py() or ""), END], dtype="<u4")
                at, n = 0, len(ids)
                view = memoryview(ids.view(np.uint8))
                lengths = (capacity,) * (n // capacity) + shapes[n % capacity]
                for length in lengths:
                    k = capacity // length
                    seen[k] = i = seen.get(k, -1) + 1
                    rows.append((at, length, zlib.crc32(view[4 * at : 4 * (at + length)]), k, i))
                    at += length
                counts.append(len(lengths))
                total.append(n)
            start, length, crc, k, i = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            doc = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            values = [doc, *map(pa.array, (start, length, crc, np.repeat(np.array(total, dtype=np.int64), counts), np.full(len(start), part, dtype=np.int64), k, i))]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "k", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, k long, at long")


def fill_rests(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Rows (k, first, end, sequence) for the pieces that fill no bin of their class, fewer than k of each class k.

    At most `capacity` classes have rests, whatever the corpus: they go, largest first, where they still fit.
    """
    base = sum(n // k for k, n in counts.items())
    left = {k: [n - n % k, n] for k, n in sorted(counts.items()) if n % k}
    rows, sequence = [], base
    while left:
        room = capacity
        for k in list(left):
            first, end = left[k]
            take = min(end - first, room // (capacity // k))
            if take:
                rows.append((k, first, first + take, sequence))
                room -= take * (capacity // k)
                left[k][0] += take
                if left[k][0] == end:
                    del left[k]
        sequence += 1
    return rows


def harmonic_pack(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents (doc_id, text) with sequence_id and offset, in sequences of at most `capacity` ids.

    A document is its ids, as `tokenizers` gives them for the file at `path` without adding special tokens (one that the
    file names, as <|endoftext|>, is that token where a text holds its string), and then END (a null or empty text: END
    alone), whatever the text's length. It is cut into full sequences and into
    pieces whose length is a k-th of the capacity; short rests stay whole. A bin of class k holds k pieces of it. Bins
    are numbered by the piece's place in its class over the whole corpus: its place in its partition, which the
    tokenising task counts, plus the pieces of the class in earlier partitions, so partitions work independently and
    leave no bin of their own half full. What remains of each class over the corpus, under `capacity` pieces whatever
    its size, fills shared bins. Rows that repeat, or repeat an id or have none, are packed each, ties among pieces of a
    class going by their place in the partition; other columns are left; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path or vocabulary_path(), capacity))
    parts = cut.groupBy("part", "k").agg(F.count(F.lit(1)).alias("_n"))
    parts = written(parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    counts = {r["k"]: r["n"] for r in parts.groupBy("k").agg(F.sum("_n").alias("n")).collect()}  # one row a class
    base, classes = 0, []
    for k, n in sorted(counts.items()):
        classes.append((k, n - n % k, base))
        base += n // k
    by_class = spark.createDataFrame(classes, "k long, _full long, _base long")
    rests = spark.createDataFrame(fill_rests(counts, capacity), "k long, _from long, _to long, _rest long")
    numbered = cut.join(parts, ["part", "k"]).withColumn("_i", F.col("at") + F.col("_before")).join(F.broadcast(by_class), "k")
    whole = numbered.where(F.col("_i") < F.col("_full")).withColumn("sequence_id", F.col("_base") + F.floor(F.col("_i") / F.col("k")))
    rest = numbered.where(F.col("_i") >= F.col("_full")).join(F.broadcast(rests), "k").where((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to"))).withColumn("sequence_id", F.col("_rest"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "k", "_i"]
    placed = whole.select(*keep).unionByName(rest.select(*keep))
    before = Window.partitionBy("sequence_id").orderBy("k", "_i").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("k", "_i")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids: one row a piece, as harmonic_pack has it.

    Null and empty texts are one id, END; texts of any length are encoded whole; repeated rows and ids are packed each; other
    columns are left; an empty table gives no rows.
    """
    return harmonic_pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs (its columns doc_id and text; others, whatever their names, are left) in sequences of at most 2048 ids.

    Null, empty and long texts, repeated rows and an empty docs as in op6_packing.
    """
    return harmonic_pack(docs)
