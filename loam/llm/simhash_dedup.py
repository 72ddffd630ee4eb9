"""SimHash near-duplicates: random bit sampling over several tables, candidates verified by distance."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import boxed, connected_components, discard, local_components, table, written

#: Bits of a fingerprint, and the largest distance of near-duplicates.
BITS, DISTANCE = 256, 50
#: Bits that a table samples, at least, for up to NODES fingerprints; of each table FURTHER more bits can split a bucket of over BUCKET.
SAMPLED, NODES, FURTHER, BUCKET = 14, 1 << 24, 16, 16384
#: Share of the pairs of the largest distance that the tables bring together; of lesser distances it is more.
RECALL = 0.94
SEED = 20240611
#: Runs of letters of scripts without breaks between words (Thai to Tibetan, Burmese, Khmer, kana, Han), and the signs of a feature in them.
UNBROKEN = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")
GRAM = 3


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values scrambled (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(text: str) -> set[str]:
    """A text's words (split at white space); where a script has no breaks between words, every GRAM signs in a row."""
    if text.isascii() or not UNBROKEN.search(text):
        return set(text.split())
    out = set(UNBROKEN.sub(" ", text).split())
    for run in UNBROKEN.findall(text):
        out.update(run[k : k + GRAM] for k in range(max(1, len(run) - GRAM + 1)))
    return out


def simhash(text: str) -> bytes | None:
    """Fingerprint of the set of a text's features; None without any."""
    words = features(text)
    if not words:
        return None
    base = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(base), 4096):
        part = base[k : k + 4096]
        bits = np.stack([mixed(part + np.uint64(lane << 40)) for lane in range(BITS // 64)], axis=1)
        ones += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(base)).tobytes()


def met(distance: int, sampled: int) -> float:
    """Chance that `sampled` of the BITS coordinates, drawn without return, are none of `distance` given ones."""
    return math.prod((BITS - distance - k) / (BITS - k) for k in range(sampled))


def parameters(nodes: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """Sampled bits and tables for so many fingerprints.

    A bit more for each 1.6-fold of NODES keeps buckets as large as they are there (fingerprints of unlike texts agree in about
    0.6 of their bits), and the tables follow from the recall that is owed at `distance`, whatever the size.
    """
    sampled = SAMPLED + max(0, math.ceil(math.log(max(nodes, 1) / NODES) / math.log(1.6)))
    return sampled, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met(distance, sampled))))


def sampled_keys(fingerprints: np.ndarray, sampled: int, tables: int, further: int = 0, seed: int = SEED) -> np.ndarray:
    """For rows of 32 bytes the bits that each table samples, and below them `further` additional ones, as a number a table."""
    bits = np.unpackbits(fingerprints, axis=1)
    rng = np.random.default_rng(seed)
    keys = np.empty((len(bits), tables), np.int64)
    for t in range(tables):
        order = rng.permutation(BITS)
        keys[:, t] = bits[:, order[: sampled + further]].astype(np.int64) @ (1 << np.arange(sampled + further, dtype=np.int64)[::-1])
    return keys


def fingerprinted(docs: DataFrame) -> DataFrame:
    """id, fp (binary, null for texts without words) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, fp binary")


def with_keys(nodes: DataFrame, sampled: int, tables: int) -> DataFrame:
    """nodes (fp, node, n) with keys, one number a table: the table's, its sampled bits, and FURTHER additional bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = sampled_keys(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1), sampled, tables, FURTHER)
                flat = pa.array((keys + (np.arange(tables, dtype=np.int64) << (sampled + FURTHER))).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), flat)
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "keys"])

    return nodes.select("fp", "node", "n").mapInArrow(run, "fp binary, node long, n long, keys array<long>")


def tiles(found: DataFrame, bucket: int) -> DataFrame:
    """(bucket, low, high, side, node, n, fp) from rows (node, n, fp, key): what of each bucket is to be compared together.

    A bucket of up to `bucket` rows is one tile (low = high = 0). A larger one is split by additional sampled bits, as many
    as would do if they fell evenly; what of it still is too large, as near copies are, by hash. Every pair of its blocks is
    a tile, and every block one with itself, so no link is lost and no task holds more than two blocks.
    """
    home, inner = F.shiftright("key", FURTHER), F.col("key").bitwiseAND(F.lit((1 << FURTHER) - 1))
    found = found.select("node", "n", "fp", home.alias("bucket"), inner.alias("inner"))
    large = found.groupBy("bucket").count().where(F.col("count") > bucket)
    large = written(large.select("bucket", F.least(F.ceil(F.log2(F.col("count") / bucket)), F.lit(FURTHER)).cast("int").alias("bits")))
    cell = F.expr(f"shiftright(inner, {FURTHER} - bits)").alias("cell")
    cells = found.join(large, "bucket").select("bucket", cell).groupBy("bucket", "cell").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("parts"))
    ordered = Window.partitionBy("bucket").orderBy("cell")  # at most 2 ** FURTHER cells
    first = F.sum("parts").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    cells = written(cells.select("bucket", "cell", "parts", F.coalesce(first, F.lit(0)).alias("first"), F.sum("parts").over(Window.partitionBy("bucket")).alias("blocks")))
    split = found.join(large, "bucket", "left").withColumn("cell", cell).join(cells, ["bucket", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("own", F.coalesce(F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")), F.lit(0)).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return split.select("bucket", low.alias("low"), high.alias("high"), (F.col("own") != low).alias("side"), "node", "n", "fp")


def close_pairs(group: np.ndarray, side: np.ndarray, crossed: np.ndarray, words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows of equal group (sorted) within `limit` bits; where `crossed` is set, only pairs of unequal side."""
    found_a, found_b = [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    two = crossed[starts]
    small = np.repeat((sizes <= 64) & ~two, sizes)
    rest = np.flatnonzero(small)
    left = np.repeat(sizes - 1, sizes) - (np.arange(len(group)) - np.repeat(starts, sizes))
    shift = 1
    while len(rest := rest[left[rest] >= shift]):
        d = np.bitwise_count(words[rest] ^ words[rest + shift]).sum(axis=1, dtype=np.int32)
        near = rest[d <= limit]
        found_a.append(near)
        found_b.append(near + shift)
        shift += 1
    for s, n, cross in zip(starts, sizes, two):
        if n <= 64 and not cross:
            continue
        rows = np.arange(s, s + n)
        one, other = (rows[side[rows] == 0], rows[side[rows] == 1]) if cross else (rows, rows)
        for k in range(0, len(one), 256):
            a = one[k : k + 256]
            b = other if cross else other[k:]
            d = np.zeros((len(a), len(b)), np.int32)
            for lane in range(words.shape[1]):
                d += np.bitwise_count(words[a, lane][:, None] ^ words[b, lane][None, :])
            i, j = np.nonzero(d <= limit)
            i, j = a[i], b[j]
            found_a.append(i if cross else i[i < j])
            found_b.append(j if cross else j[i < j])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_a), np.concatenate(found_b)


def bucket_links(rows: DataFrame, sampled: int, tables: int, limit: int) -> DataFrame:
    """(node, degree, root) from the rows of tiles(), partitioned and sorted by tile.

    A link counts in the first table in which its two ends share a bucket; root is the least node that the links of the
    tiles at hand lead to. Tiles are taken many at a time; at most one is held beyond a batch's end.
    """

    def begins(t: pa.Table) -> np.ndarray:
        columns = [t.column(c).to_numpy() for c in ("bucket", "low", "high")]
        return np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        bucket, low, high, side, n, ids = (t.column(c).to_numpy() for c in ("bucket", "low", "high", "side", "n", "node"))
        slot = bucket >> sampled
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(len(ids), -1)
        a, b = close_pairs(np.cumsum(begins(t)), side.astype(np.int8), low != high, fps.view(np.uint64), limit)
        if not len(a):
            return None
        used, inverse = np.unique(np.r_[a, b], return_inverse=True)
        keys = sampled_keys(fps[used], sampled, tables)
        first = np.empty(len(a), bool)
        for k in range(0, len(a), 1 << 16):
            p, q = inverse[: len(a)][k : k + (1 << 16)], inverse[len(a) :][k : k + (1 << 16)]
            first[k : k + (1 << 16)] = (keys[p] == keys[q]).argmax(axis=1) == slot[a[k : k + (1 << 16)]]
        nodes, place = np.unique(ids, return_inverse=True)
        pa_, pb = place[a], place[b]
        root = local_components(len(nodes), pa_, pb)
        degree = np.bincount(pa_[first], n[b[first]], len(nodes)) + np.bincount(pb[first], n[a[first]], len(nodes))
        some = np.unique(np.r_[pa_, pb])
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(degree[some].astype(np.int64)), pa.array(nodes[root[some]])], names=["node", "degree", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < 50_000:
                continue
            t = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(begins(t))[-1])
            if cut and (out := solve(t.slice(0, cut))):
                yield out
            held = t.slice(cut).combine_chunks().to_batches() if cut else held
            size = t.num_rows - cut
        if held and (out := solve(pa.Table.from_batches(held))):
            yield out

    return rows.mapInArrow(run, "node long, degree long, root long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs (id, text): id, class_id, n_links, component_id.

    Rows of equal fingerprints are a class first (class_id is its least id), so copies, however many, are one node. Every
    table samples some of the BITS coordinates (see parameters); nodes that agree in them share a bucket and their distances
    are verified; oversized buckets are split (see tiles) and lose no pair. n_links counts the other rows within `distance`,
    copies included; component_id is the least id that links lead to. Pairs are found with a chance of over RECALL at the
    largest distance and nearly 1 at small ones. Whole texts count, however long. Texts without words (null, empty, white
    space) link with nothing, nor do rows of a null id. Rows that repeat an id are rows of their own, linked by their own
    texts, under the same id; ids may be of any type that has an order. Other columns are left. An empty table gives an
    empty one.
    """
    rows = written(fingerprinted(docs).withColumn("fp", F.when(F.col("id").isNotNull(), F.col("fp"))))
    alone = rows.where("fp IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    classes = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    sampled, tables = parameters(classes.count(), distance)
    keyed = written(with_keys(classes, sampled, tables))
    sent = tiles(keyed.select("node", "n", "fp", F.explode("keys").alias("key")), bucket)
    where = ["bucket", "low", "high"]
    links = written(bucket_links(sent.repartition(*where).sortWithinPartitions(*where), sampled, tables, distance))
    discard(keyed)
    degree = links.groupBy("node").agg(F.sum("degree").alias("degree"))
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("root"))
    joined = written(classes.join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(links, classes)
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    known = joined.join(least, "root").select("fp", F.col("id").alias("class_id"), (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.where("fp IS NOT NULL").join(known, "fp").select("id", "class_id", "n_links", "component_id").unionByName(alone)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of equal fingerprints (class_id), number of links, near-duplicate group
    (component_id), and whether they are kept, as the least doc_id of a group is.

    Null and empty texts, and rows of a null doc_id, stay by themselves and are kept (where doc_id isn't null: kept is then
    doc_id = component_id); long texts count whole; rows that repeat have one fingerprint and are links of each other;
    other columns are left; an empty table gives no rows.
    """
    found = near_duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.withColumnRenamed("id", "doc_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of least doc_id (a null one is last; of equal ones any one),
    all its columns as they are, whatever their names.

    Documents without words (null or empty text) are in no group and stay; long texts count whole; of repeated rows one
    stays; an empty docs gives an empty result.
    """
    rows = boxed(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("id"), "_doc.text")).select(F.col("id").alias("_row"), "component_id")
    doc = F.col("_doc.doc_id")
    best = rows.select("_row", doc.alias("d")).join(found, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "_row")).alias("m"))
    return rows.join(best.select(F.col("m._row").alias("_row")), "_row", "left_semi").select("_doc.*")
