import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from loam.llm import fingerprints as P
from loam.llm.fingerprints import RANK, digests, fingerprinted, likeness, rarity, written_out


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_entropy_of_every_window(monkeypatch):
    buf = np.frombuffer(prose(80).encode() + b"\xff" * 70 + b"aab" * 60, np.uint8)

    def rank(window):
        return RANK[sum(round(1024 * c * math.log2(c)) for c in Counter(window).values()) >> 9]

    want = [rank(buf[i : i + 32].tobytes()) for i in range(len(buf) - 31)]
    for step in (1 << 17, 100):
        monkeypatch.setattr(P, "SLICE", step)
        assert rarity(buf).tolist() == want


def test_choice_by_brute_force(monkeypatch):
    rng = random.Random(4)
    buf = np.frombuffer(prose(60, 4).encode()[:300] + b"abc" * 60, np.uint8)
    n = len(buf) - 31
    key = np.array([rng.randrange(5) for _ in range(200)] + [7] * (n - 200), np.uint32)
    tie = lambda i: int.from_bytes(buf[i : i + 8].tobytes(), "little") * int(P.ODD) % 2**64 >> 42
    groups: list = []
    for a in range(n - 31):
        i = min(range(a, a + 32), key=lambda i: (key[i], tie(i), i))
        window = buf[i : i + 32].tobytes()
        if groups and groups[-1][1] == window:
            groups[-1][2] += 1
        else:
            groups.append([i, window, 1])
    want = [i for i, _, c in groups if c >= P.POPULAR]
    for step in (1 << 17, 90):
        monkeypatch.setattr(P, "SLICE", step)
        at, hashes = P.chosen(buf, key)
        assert at.tolist() == want and (hashes == P.feature_hashes(buf, at)).all()


def test_texts_do_not_touch_each_other():
    texts = [t.encode() for t in (prose(300, 1), "", "short", prose(5, 2), prose(60, 3), prose(5000, 4))]
    together = [written_out(f) for f in digests(texts)]
    assert together == [written_out(digests([t])[0]) for t in texts]


def test_likeness():
    a, b, c = (digests([prose(2000, s).encode()])[0] for s in (1, 2, 3))
    assert likeness(a, a) == 1 and likeness(a, b) < 0.15
    half = digests([(prose(2000, 1)[:6000] + prose(2000, 3)[:6000]).encode()])[0]
    assert 0.3 < likeness(a, half) < 0.9 and 0.3 < likeness(c, half) < 0.9 and likeness(b, half) < 0.15
    none = digests([b""])[0]
    assert likeness(none, none) == 1 and likeness(none, a) == likeness(a, none) == 0


def check(spark, rows, parts):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    got = fingerprinted(df, parts).collect()
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (xxhash.xxh64_intdigest(t.encode(), 42) >> 63 << 64)
    order = sorted(((i if i is not None else 2**63 - 1, t or "") for i, t in rows), key=lambda r: (r[0], tie(r[1])))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((None if i == 2**63 - 1 else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), written_out(digests([t.encode()])[0]), written_out(digests([edited.encode()])[0])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_successors_across_parts(spark):
    rows = [(i * 13 % 101, prose(20 + i, i)) for i in range(60)] + [(7000, None), (-5, ""), (8000, prose(60_000, 9)), (None, prose(30, 5)), (3, prose(9, 1)), (3, prose(9, 1)), (3, "zz")]
    for parts in (1, 7):
        check(spark, rows, parts)


def test_single_and_none(spark):
    check(spark, [(5, prose(40))], 3)
    assert fingerprinted(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_texts():
    units = ["a", "buy now ", "click here! ", "0123456789abcdef", "ab" * 16]
    marks = [digests([(u * (6000 // len(u))).encode()])[0] for u in units]
    assert all(len(m) for m in marks)
    assert all(likeness(a, b) < 0.5 for i, a in enumerate(marks) for b in marks[:i] if i)
    assert all(1 <= len(m) <= 1 for m in marks)
    for u, m in zip(units, marks):
        half = digests([(u * (3000 // len(u)) + prose(500, 7)).encode()])[0]
        assert likeness(m, half) > 0.3


@pytest.mark.parametrize("n", [33, 64, 96, 128, 200, 255, 256, 257, 400, 1000])
def test_one_rule_at_every_length(n):
    """A text and the same without its last byte are alike, wherever the end falls; few bytes give few features to share."""
    near = []
    for seed in range(40):
        t = prose(300, seed).encode("ascii", "replace")
        near.append(likeness(*digests([t[:n], t[: n - 1]])))
    assert np.mean(near) > (0.9 if n >= 200 else 0.7 if n >= 64 else 0.4)


def test_a_hot_id_is_divided(spark):
    rows = [(None, "same words in every row of no id")] * 300 + [(None, prose(8, k)) for k in range(100)] + [(k, prose(8, k)) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in P.with_neighbours(df, 8).where("NOT head").groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 150 and sum(sizes) == 500
    check(spark, rows, 8)


def test_query(spark):
    found = P.op9_fingerprints(spark, "/root/testdata/sf0.001")
    kinds = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    assert dict(found.dtypes) == kinds
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(docs)
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = (digests([x.encode()])[0] for x in (t, edited, u))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written_out(a), written_out(b))
        assert (r["near_edited"], r["near_next"]) == (likeness(a, b), likeness(a, c))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.3 + np.mean([r["near_next"] for r in got.values()])
