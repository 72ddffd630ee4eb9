import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.packing import CAPACITY, END, cuts, encoder, fill_rests, harmonic_pack, op6_packing, vocabulary_path

DIR = "/root/testdata/sf0.001"


@lru_cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [END]


def check(rows, docs):
    """Every id lies in exactly one piece, sequences are gapless; returns the number of sequences and of ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in docs:
        ids = np.array(ids_of(text), "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= CAPACITY
    return len(by_sequence), sum(r["length"] for r in rows)


def test_round_trip_and_little_padding(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = harmonic_pack(docs.repartition(3)).collect()
    sequences, ids = check(rows, [tuple(r) for r in docs.collect()])
    assert sequences <= 1.03 * ids / CAPACITY + 2
    assert {r["sequence_id"] for r in rows} == set(range(sequences))


def test_edge_cases(spark):
    schema = "doc_id long, text string, k string, part int"
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, "end<|endoftext|>start <|endoftext|><|endoftext|> \n", "b", 3), (4, "long words " * 30_000, "c", None)]
    check(harmonic_pack(spark.createDataFrame(rows, schema)).collect(), [r[:2] for r in rows])
    assert harmonic_pack(spark.createDataFrame([], schema)).count() == 0
    repeated = harmonic_pack(spark.createDataFrame([(None, "x y", "", 0)] * 5, schema)).collect()
    assert len(repeated) == 5 and len({(r["sequence_id"], r["offset"]) for r in repeated}) == 5


def test_long_white_space(spark):
    n = 1_100_000
    texts = ["w" + " " * n + "w", "\n" * n, "a \n" + "\u00a0 " * (n // 2) + "\n's", " " * n + "  12" + "\t" * n + "!", "\x1c" * 200_000 + " x", " " * 150_000 + "<|endoftext|>" + "\n" * 150_000 + "<|endoftext|> x"]
    rows = list(enumerate(texts))
    check(harmonic_pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_added_token_is_one_id():
    assert encoder(vocabulary_path()).ids("<|endoftext|>") == [50256]
    assert encoder(vocabulary_path()).ids("end<|endoftext|>start") == [437, 50256, 9688]


@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\u00a0'|<>st")), max_size=60), st.text(max_size=9))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizer(a, b):
    text = a + "<|endoftext|>" + b.encode("utf-8", "replace").decode()
    for t in (a, text):
        assert encoder(vocabulary_path()).ids(t) + [END] == ids_of(t)


def test_query_has_the_columns_asked_for(spark):
    found = op6_packing(spark, DIR)
    assert dict(found.dtypes) == {"doc_id": "bigint", "sequence_id": "bigint", "offset": "bigint"} | {c: "bigint" for c in ("start", "length", "ids_crc32", "doc_tokens")}
    sequences, ids = check(found.collect(), [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()])
    assert sequences <= 1.03 * ids / CAPACITY + 2


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 1025, 2047, 2048, 2049, 10_000])
def test_cuts_add_up(n):
    pieces = cuts(n)
    assert sum(pieces) == n and all(0 < p <= CAPACITY for p in pieces)


def test_rests_fit():
    counts = {k: 3 * k + (k * 7) % k if k > 1 else 2 for k in range(1, 40)} | {5: 19, 7: 20}
    seen = defaultdict(int)
    for k, a, b, s in fill_rests(counts, CAPACITY):
        seen[s] += (b - a) * (CAPACITY // k)
    assert all(v <= CAPACITY for v in seen.values())
