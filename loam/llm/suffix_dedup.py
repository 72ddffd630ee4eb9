"""Exact removal of repeated passages: suffixes sorted bucket by bucket, long ties resolved by ranks of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import boxed, discard, table, written

#: Bytes of a passage, to which suffixes are compared.
DEPTH = 50
#: A difference cover: every number is a difference of two of COVER modulo PERIOD. Its positions' grams are the sample.
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
GRAM = DEPTH - PERIOD + 1
#: Bytes that a sampled gram may have on either side within a passage.
SIDE = DEPTH - GRAM
#: Text of a chunk, windows sorted at once, occurrences beyond which a gram's suffixes are spread, and up to which they are compared in pairs.
CHUNK_BYTES, SORTED, HOT, FEW = 8_000_000, 1 << 21, 20_000, 128
#: Parts of a spread gram: the first and last distance of it from a passage's begin.
SPREAD = ((0, 10), (11, 20), (21, 30))
AROUND = np.r_[-SIDE:0, GRAM : GRAM + SIDE]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def at_any(buf: np.ndarray) -> np.ndarray:
    """The 8-byte words of buf that start at each of its bytes."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, 0, (1,))


def words_at(word: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Words that cover the strings of `length` bytes (8 at least) at `start`: strings are equal if all of them are."""
    return [word[start + o] for o in (*range(0, length - 8, 8), length - 8)]


def hash_of(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(words[0]), np.uint64)
    for k, w in enumerate(words):
        out = scrambled(out ^ w) + np.uint64(k)
    return scrambled(out)


def cover_sample(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of the cover's positions, counted from each document's begin, that have a whole gram before its end.

    Two passages at places i and j have grams at i + d and j + d in them for some d under PERIOD, both of them sampled.
    """
    whole = np.where(length >= DEPTH, length - GRAM + 1, 0)
    below = np.searchsorted(COVER, np.arange(PERIOD))
    count = len(COVER) * (whole // PERIOD) + below[whole % PERIOD]
    doc = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, begin[doc] + PERIOD * (nth // len(COVER)) + COVER[nth % len(COVER)]


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers compressed, byte planes apart."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(x.dtype.char.encode() + planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Chunk:
    """Documents of a chunk in order of (doc, row), copies of other documents apart."""

    def __init__(self, t: pa.Table):
        copy = t.column("copy").to_numpy()
        doc, row, h = (t.column(c).to_numpy() for c in ("doc", "row", "h"))
        known = set(zip(doc[copy], h[copy]))
        own = np.array([not c and (not known or (d, x) not in known) for c, d, x in zip(copy, doc, h)], bool)
        order = np.flatnonzero(own)
        order = order[np.lexsort((h[order], row[order], doc[order]))]
        text = t.column("text")
        self.texts = [text[int(i)].as_py().encode() for i in order]
        self.row, self.doc = row[order], doc[order]
        self.lengths = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.ends = np.cumsum(self.lengths)
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)


def bucket_of(rank: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranks of `bits` bits in as many ranges."""
    kept = min(bits, 32)
    return ((rank >> np.uint64(bits - kept)) * np.uint64(buckets) >> np.uint64(kept)).astype(np.int64)


def ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    cut = runs(bucket)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
        yield int(bucket[a]), a, b


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, int)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


class Sample:
    """The sampled grams of a chunk: document, place, rank (the gram's name, `bits` bits of a hash, in whose order buckets are), and
    the ranks in order with how often they occur and whether in two documents."""

    def __init__(self, c: Chunk, bits: int):
        self.doc, self.place = cover_sample(c.ends - c.lengths, c.lengths)
        word = at_any(c.buf)
        self.rank = hash_of(words_at(word, self.place, GRAM)) >> np.uint64(64 - bits) if len(self.place) else np.zeros(0, np.uint64)
        order = np.argsort(self.rank, kind="stable")
        s, d = self.rank[order], c.doc[self.doc[order]]
        new = runs(s)
        self.ranks, self.count = s[new], np.diff(np.r_[new, len(s)])
        self.several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new) if len(new) else np.zeros(0, bool)
        self.of = np.empty(len(order), int)
        self.of[order] = np.repeat(np.arange(len(new)), self.count)


def contexts_of(c: Chunk, s: Sample, state: np.ndarray, bits: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """What is to be sent of a chunk, (route, doc, start, n, g), and what is marked at once, (start, n).

    For each sampled gram whose state (0: no other document has it; 2: hot) isn't 0 these are the n passages around it, from
    `start` on, the gram lying g bytes behind it. Of equal contexts the least document's go out; those of greater documents
    are marked. A hot gram's passages go in parts, routed by the bytes that all passages of a part share.
    """
    some = np.flatnonzero(state[s.of]) if len(s.of) else np.zeros(0, int)
    doc, place, rank, hot = s.doc[some], s.place[some], s.rank[some], state[s.of[some]] == 2 if len(some) else np.zeros(0, bool)
    begin = (c.ends - c.lengths)[doc] if len(doc) else doc
    left = np.minimum(SIDE, place - begin)
    right = np.minimum(SIDE, c.ends[doc] - place - GRAM) if len(doc) else doc
    ok = left + right >= SIDE
    doc, place, rank, hot, left, right = (x[ok] for x in (doc, place, rank, hot, left, right))
    n, start, owner = left + right - SIDE + 1, place - left, c.doc[doc]
    word = at_any(c.buf)
    if len(start):
        ends = words_at(word, start, DEPTH), words_at(word, start + n - 1, DEPTH)
        h = scrambled(hash_of(ends[0]) ^ hash_of(ends[1]) + n.astype(np.uint64))
        order = np.lexsort((owner, h))
        same = np.r_[False, h[order][1:] == h[order][:-1]]
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        equal = (n[order] == n[first]) & (left[order] == left[first])
        for w in (*ends[0], *ends[1]):
            equal &= w[order] == w[first]
        known = np.zeros(len(order), bool)
        known[order] = equal & (owner[order] > owner[first])
    else:
        known = np.zeros(0, bool)
    sent = np.flatnonzero(~known)
    cold, spread = sent[~hot[sent]], sent[hot[sent]]
    out = [(rank[cold], owner[cold], start[cold], n[cold], left[cold])]
    for k, (low, high) in enumerate(SPREAD):
        from_, to = np.maximum(low, SIDE - right[spread]), np.minimum(high, left[spread])
        x, from_, to = spread[from_ <= to], from_[from_ <= to], to[from_ <= to]
        if len(x):
            shared = hash_of(words_at(word, place[x] - low, low + GRAM + SIDE - high))
            out.append((scrambled(shared + np.uint64(k)) >> np.uint64(64 - bits), owner[x], place[x] - to, to - from_ + 1, to))
    return tuple(np.concatenate(x) for x in zip(*out)), (start[known], n[known])


def repeated(route: np.ndarray, doc: np.ndarray, n: np.ndarray, g: np.ndarray, buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Masks of the n passages of each context, a bit set where a smaller document has the passage in a context of this bucket.

    Contexts of one route are a suffix bucket, and buckets are sorted in turn. The first order is that of the gram, whose
    place in it is its exact rank; passages with the gram at the same distance are then compared by the SIDE bytes before
    and after it alone, as their tie on the gram is known by its rank. Up to FEW contexts of a rank are compared in pairs,
    by how far they agree on either side; more are sorted, one distance after the other.
    """
    mask = np.zeros(len(n), np.uint32)
    order = np.lexsort((doc, route))
    rs = route[order]
    edge = np.r_[runs(rs), len(rs)]
    word = at_any(buf)
    most = max(1, SORTED // PERIOD)
    a = 0
    while a < len(order):
        b = int(edge[np.searchsorted(edge, min(a + most, len(order)), "right") - 1])
        b = b if b > a else int(edge[np.searchsorted(edge, a, "right")])
        x = order[a:b]
        a = b
        grams = words_at(word, begin[x] + g[x], GRAM)
        by = np.lexsort((doc[x], *grams, route[x]))
        x, grams = x[by], [w[by] for w in grams]
        new = runs(route[x], *grams)
        size = np.diff(np.r_[new, len(x)])
        few = np.repeat((size > 1) & (size <= FEW), size)
        at = np.repeat(new, size)
        mask[x[few]] = in_pairs(doc[x[few]], n[x[few]], g[x[few]], sides(buf, begin[x[few]] + g[x[few]]), runs(at[few]))
        many = np.repeat(size > FEW, size)
        if many.any():
            mask[x[many]] = in_order(at[many], doc[x[many]], n[x[many]], g[x[many]], sides(buf, begin[x[many]] + g[x[many]]))
    return mask


def sides(buf: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The SIDE bytes before and after each gram; beyond a context's ends any, which its limits keep from counting."""
    out = np.empty((len(place), 2 * SIDE), np.uint8)
    for k in range(0, len(place), 1 << 15):
        out[k : k + (1 << 15)] = buf[np.clip(place[k : k + (1 << 15), None] + AROUND, 0, len(buf) - 1)]
    return out


def in_pairs(doc: np.ndarray, n: np.ndarray, g: np.ndarray, side: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Masks of contexts in groups that begin at `new`, documents ascending in each."""
    mask = np.zeros(len(doc), np.uint32)
    full = np.uint32(0xFFFFFFFF) >> (32 - n).astype(np.uint32)
    size = np.diff(np.r_[new, len(doc)])
    left = np.repeat(size - 1, size) - (np.arange(len(doc)) - np.repeat(new, size))
    before = np.ascontiguousarray(side[:, SIDE - 1 :: -1]) if len(side) else side
    rest, shift = np.arange(len(doc)), 1
    while len(rest := rest[left[rest] >= shift]):
        pick = rest[(doc[rest] < doc[rest + shift]) & (mask[rest + shift] != full[rest + shift])]
        for k in range(0, len(pick), 1 << 15):
            p = pick[k : k + (1 << 15)]
            q = p + shift
            agree = []
            for own, off in ((before, 0), (side, SIDE)):
                unlike = own[p, off : off + SIDE] != own[q, off : off + SIDE]
                agree.append(np.where(unlike.any(axis=1), unlike.argmax(axis=1), SIDE))
            low = np.maximum(SIDE - agree[1], np.maximum(g[p] - n[p], g[q] - n[q]) + 1)
            high = np.minimum(agree[0], np.minimum(g[p], g[q]))
            hit = low <= high
            q, low, high = q[hit], low[hit], high[hit]
            mask[q] |= (np.uint32(0xFFFFFFFF) >> (31 - high + low).astype(np.uint32)) << (g[q] - high).astype(np.uint32)
        shift += 1
    return mask


def in_order(rank: np.ndarray, doc: np.ndarray, n: np.ndarray, g: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Masks of contexts in order of (rank, doc)."""
    mask = np.zeros(len(doc), np.uint32)
    for d in range(SIDE + 1):
        x = np.flatnonzero((d <= g) & (d > g - n))
        if not len(x):
            continue
        own = np.zeros((len(x), SIDE + 2), np.uint8)
        own[:, :SIDE] = side[x, SIDE - d : 2 * SIDE - d]
        own = own.view("<u8").reshape(len(x), -1)
        by = np.lexsort((*own.T, rank[x]))  # a stable sort, so documents still ascend among equals
        new = runs(rank[x][by], *own[by].T)
        least = np.repeat(doc[x][by][new], np.diff(np.r_[new, len(x)]))
        hit = x[by[doc[x][by] > least]]
        mask[hit] |= np.uint32(1) << (g[hit] - d).astype(np.uint32)
    return mask


def removed_passages(docs: DataFrame, kept: bool = False, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, the rest as binary) of rows (row, doc, text).

    A byte goes if a string of DEPTH bytes over it also starts in a row of smaller doc. Equal texts are settled first:
    only those of the least doc go on. Chunks of about chunk_bytes of text, by hash, then work in three steps, and only
    compressed columns pass between chunks:
    1. cover ranks: the grams at the positions of a difference cover (6 of 31) stand for all passages; every chunk sends
       its grams' ranks, and learns one bit of each: whether a second document has it. Passages around others occur once.
    2. the text around the grams left goes to the bucket of its rank; buckets are sorted one after the other (repeated),
       ties resolved by rank, all else compared byte by byte, and passages that a smaller document has are marked. Grams
       of over `hot` occurrences are spread over buckets by further bytes; what a chunk has twice is sent once.
    3. marks go back to the chunks, which cut their texts.
    Texts of any length are compared whole, each within one task. Null texts are empty; rows of a null doc come after all
    others and lose nothing to each other, nor do rows that repeat a doc; a null row stays null. Ties don't matter, other
    columns are left. An empty table gives an empty one.
    """
    no_row = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("row").cast("long"), no_row).alias("row"), F.coalesce(F.col("doc").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    narrow = written(rows.select("row", "doc", "h", F.sha2("text", 256).alias("m"), F.octet_length("text").cast("long").alias("n"), F.when(F.octet_length("text") < DEPTH, F.col("text")).alias("short")))
    least = narrow.groupBy("m").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    copies = written(narrow.join(least, "m").where("doc > least").select("row", "doc", "h", "n", "short"))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    discard(narrow)
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-chunks // 2))
    # a rank in 256 may be one of two grams; that only costs a comparison
    bits = min(60, max(16, (total // 5).bit_length() + 8))
    chunk = F.pmod(F.xxhash64("doc", "h"), F.lit(chunks)).cast("int").alias("chunk")
    first = rows.select(chunk, "row", "doc", "h", "text", F.lit(False).alias("copy"))
    known = copies.select(chunk, "row", "doc", "h", F.lit("").alias("text"), F.lit(True).alias("copy"))
    base = first.unionByName(known).repartition("chunk")

    def sample(t: pa.Table) -> pa.Table:
        s = Sample(Chunk(t), bits)
        out = [(b, squeeze(np.diff(s.ranks[i:j], prepend=np.uint64(0))), squeeze(np.minimum(s.count[i:j], 255).astype(np.uint8)), squeeze(s.several[i:j].view(np.uint8))) for b, i, j in ranges(bucket_of(s.ranks, bits, buckets))]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()] * len(out), pa.int32()), **{n: pa.array([o[k + 1] for o in out], pa.binary()) for k, n in enumerate(("ranks", "count", "several"))}})

    def alive(t: pa.Table) -> pa.Table:
        parts = [np.cumsum(unsqueeze(x.as_py()), dtype=np.uint64) for x in t.column("ranks")]
        rank = np.concatenate(parts)
        count = np.concatenate([unsqueeze(x.as_py()) for x in t.column("count")]).astype(np.int64)
        several = np.concatenate([unsqueeze(x.as_py()) for x in t.column("several")]).astype(np.int64)
        order = np.argsort(rank, kind="stable")
        new = runs(rank[order])
        size = np.diff(np.r_[new, len(order)])
        live = (size > 1) | (np.add.reduceat(several[order], new) > 0)
        state = live.astype(np.uint8) + (live & (np.add.reduceat(count[order], new) > hot))
        back = np.empty(len(rank), np.uint8)
        back[order] = np.repeat(state, size)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "state": pa.array([squeeze(x) for x in np.split(back, cuts)], pa.binary())})

    def contexts(t: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "marks", "route", "doc", "start", "n", "g", "text")}
        if t.num_rows:
            me = t.column("chunk")[0].as_py()
            c = Chunk(t)
            s = Sample(c, bits)
            got = {b.as_py(): x.as_py() for b, x in zip(replies.column("bucket"), replies.column("state"))}
            state = np.concatenate([unsqueeze(got[b]) for b, _, _ in ranges(bucket_of(s.ranks, bits, buckets))] or [np.zeros(0, np.uint8)])
            (route, doc, start, n, g), (known, known_n) = contexts_of(c, s, state, bits)
            by = np.argsort(route, kind="stable")
            for b, i, j in ranges(bucket_of(route[by], bits, buckets)):
                x = by[i:j]
                length = n[x] + DEPTH - 1
                at = np.repeat(start[x] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
                text = zstandard.ZstdCompressor(level=1).compress(c.buf[at].tobytes())
                for k, v in zip(out, (b, me, False, squeeze(np.diff(route[x], prepend=np.uint64(0))), squeeze(doc[x]), squeeze(start[x].astype(np.uint32)), squeeze(n[x].astype(np.uint8)), squeeze(g[x].astype(np.uint8)), text)):
                    out[k].append(v)
            if len(known):
                x = np.argsort(known, kind="stable")
                for k, v in zip(out, (me % buckets, me, True, b"", b"", squeeze(known[x].astype(np.uint32)), squeeze((np.uint32(0xFFFFFFFF) >> (32 - known_n[x]).astype(np.uint32)).astype(np.uint32)), b"", b"")):
                    out[k].append(v)
        kinds = {"bucket": pa.int32(), "chunk": pa.int32(), "marks": pa.bool_()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def marked(t: pa.Table) -> pa.Table:
        marks = t.column("marks").to_numpy()
        out = [(t.column("chunk")[int(i)].as_py(), t.column("start")[int(i)].as_py(), t.column("n")[int(i)].as_py()) for i in np.flatnonzero(marks)]
        t = t.filter(pa.array(~marks))
        if t.num_rows:
            route, doc, n, g = ([unsqueeze(x.as_py()) for x in t.column(c)] for c in ("route", "doc", "n", "g"))
            sizes = [len(x) for x in n]
            route = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in route])
            doc, n, g = np.concatenate(doc), np.concatenate(n).astype(np.int64), np.concatenate(g).astype(np.int64)
            buf = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in t.column("text")), np.uint8)
            length = n + DEPTH - 1
            mask = repeated(route, doc, n, g, buf, np.cumsum(length) - length)
            for chunk_, start, m in zip(t.column("chunk"), t.column("start"), np.split(mask, np.cumsum(sizes)[:-1])):
                some = np.flatnonzero(m)
                if len(some):
                    out.append((chunk_.as_py(), squeeze(unsqueeze(start.as_py())[some]), squeeze(m[some])))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int32()), "start": pa.array([o[1] for o in out], pa.binary()), "mask": pa.array([o[2] for o in out], pa.binary())})

    def cut(t: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept]
        out: list[list] = [[] for _ in names]
        if t.num_rows:
            c = Chunk(t)
            flag = np.zeros(len(c.buf) + 1, bool)
            for start, mask in zip(marks.column("start"), marks.column("mask")):
                s, m = unsqueeze(start.as_py()).astype(np.int64), unsqueeze(mask.as_py())
                for bit in range(PERIOD):
                    flag[s[(m >> np.uint32(bit)) & np.uint32(1) == 1] + bit] = True
            at = np.flatnonzero(flag)
            delta = np.zeros(len(c.buf) + 1, np.int32)
            delta[at] += 1
            delta[at + DEPTH] -= 1
            gone = np.cumsum(delta)[:-1] > 0 if len(at) else np.zeros(len(c.buf), bool)
            begin = c.ends - c.lengths
            for k, text in enumerate(c.texts):
                i, j = int(begin[k]), int(c.ends[k])
                lost, spans, rest = int(gone[i:j].sum()), 0, text
                if lost:
                    g = gone[i:j]
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                    rest = c.buf[i:j][~g].tobytes()
                values = (int(c.row[k]), len(text), lost, spans, hashlib.sha256(rest).hexdigest(), *[whole_characters(text, gone[i:j]) if lost else text] * kept)
                for to, v in zip(out, values):
                    to.append(v)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table({k: pa.array(v, kind) for k, v, kind in zip(names, out, kinds)})

    sampled = base.groupBy("chunk").applyInArrow(sample, "bucket int, chunk int, ranks binary, count binary, several binary")
    replies = sampled.groupBy("bucket").applyInArrow(alive, "chunk int, bucket int, state binary")
    sent = base.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(contexts, "bucket int, chunk int, marks boolean, route binary, doc binary, start binary, n binary, g binary, text binary")
    marks = sent.groupBy("bucket").applyInArrow(marked, "chunk int, start binary, mask binary")
    schema = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    mine = base.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(cut, schema)
    all_gone = F.col("n") >= DEPTH
    rest = F.encode(F.coalesce("short", F.lit("")), "utf-8")
    whole = copies.select("row", F.col("n").alias("n_bytes"), F.when(all_gone, F.col("n")).otherwise(0).cast("long").alias("n_removed"), all_gone.cast("long").alias("n_spans"), F.sha2(rest, 256).alias("kept_sha256"), *[rest.alias("kept")] * kept)
    return mine.unionByName(whole).withColumn("row", F.nullif("row", no_row))


def whole_characters(text: bytes, gone: np.ndarray) -> bytes:
    """What is left of a text; of characters that only lose some of their bytes, none."""
    raw = np.frombuffer(text, np.uint8)
    lead = np.cumsum((raw & 0xC0) != 0x80) - 1
    whole = np.ones(int(lead[-1]) + 1, bool)
    whole[lead[gone]] = False
    return raw[whole[lead]].tobytes()


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what repeated passages they lose: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes; texts under 50 bytes lose nothing; longer ones of any length count whole; rows that
    repeat a doc_id, or have none, lose nothing to each other; other columns are left; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    found = removed_passages(docs.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("doc"), "text"))
    return found.withColumnRenamed("row", "doc_id")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages cut out of their texts; those of which nothing is left go. n_chars follows the text; all
    other columns stay as they are, whatever their names.

    Characters of which only some bytes go are cut out whole. Null texts stay null, empty ones empty; long texts, repeated
    rows and an empty docs as in removed_passages.
    """
    rows = boxed(docs)
    found = removed_passages(rows.select(F.col("_row").alias("row"), F.col("_doc.doc_id").alias("doc"), "_doc.text"), kept=True)
    some = found.where("n_removed = 0 OR octet_length(kept) > 0").select(F.col("row").alias("_row"), F.col("kept").cast("string").alias("_kept"))
    others = [f"_doc.`{c}`" for c in docs.columns if c != "text"]
    rest = rows.select(F.struct(*others).alias("_doc"), F.col("_doc.text").isNull().alias("_null"), "_row").join(some, "_row")
    text = F.when(~F.col("_null"), F.col("_kept"))
    count = {"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rest.select(*[(count | {"text": text}).get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


#: Bytes as pairs of hexadecimal digits, so that positions are those of bytes.
OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
j AS (SELECT doc_id, h, len(h) // 2 - 49 AS n, unnest(range(0, len(h) // 2 - 49, 256)) AS j FROM d),
t AS (SELECT doc_id, j, least(256, n - j) AS n, substr(h, 2 * j + 1, 610) AS t FROM j),
p AS (SELECT doc_id, j, t, unnest(range(0, n)) AS i FROM t),
w AS (SELECT doc_id, j + i AS i, substr(t, 2 * i + 1, 100) AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE least < doc_id),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
o AS (SELECT doc_id, COUNT(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""
