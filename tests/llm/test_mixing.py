import hashlib
import math
import re

import duckdb

from loam.llm.mixing import OP7_SQL, mixing_stage, op7_mixing, systematic_mix, with_sizes


def targets(sizes, share=1.5, most=2):
    """By repeated sharing of what is above the limits."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= over
    return out


ROWS = [(i, "w " * (i * 37 % 23 + i % 5), f"s{i % 4}" if i % 9 else None) for i in range(300)] + [(300, None, "s1"), (301, "  ", "s9"), (302, "x " * 50_000, "s2"), (None, "a b c", "s0"), (5, "a b", "s0"), (5, "a b", "s0")]
SCHEMA = "doc_id long, text string, source string"


def test_targets_and_taken(spark):
    out = systematic_mix(with_sizes(spark.createDataFrame(ROWS, SCHEMA))).collect()
    assert len(out) == len(ROWS)
    sizes: dict = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    for s in sizes:
        rows = [r for r in out if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[s] for r in rows)
        assert all(0 <= r["copies"] <= 2 for r in rows)
        taken = sum(r["size"] * r["copies"] for r in rows)
        assert abs(taken - want[s]) <= max(r["size"] for r in rows) + 1


def test_systematic_rule_by_hand(spark):
    """One boundary of the prefix sums, moved by the offset, is one copy."""
    rows = [(i, "w " * 3, "only") for i in range(50)]
    got = {r["doc_id"]: r["copies"] for r in systematic_mix(with_sizes(spark.createDataFrame(rows, SCHEMA))).collect()}
    u = int(hashlib.md5(b"mix-1:sonly").hexdigest()[:8], 16) / 2**32
    e = 1.5
    assert got == {i: math.floor((i + 1) * e + u) - math.floor(i * e + u) for i in range(50)}


def test_stage_repeats_rows(spark):
    docs = spark.createDataFrame([(*r, "x", k, None) for k, r in enumerate(ROWS)], SCHEMA + ", copies string, _row long, _doc string")
    out = mixing_stage(spark, docs, "")
    assert {(r["_row"], r["doc_id"], r["text"]) for r in out.collect()} <= {(k, *r[:2]) for k, r in enumerate(ROWS)}
    copies = sum(r["copies"] for r in systematic_mix(with_sizes(docs)).collect())
    assert out.columns == docs.columns and out.count() == copies
    assert mixing_stage(spark, docs.limit(0), "").count() == 0


def test_large_documents_have_their_chances(spark):
    """A document of any part of its source is taken its expected copies, over many offsets."""
    sizes = [200, 400, 400] + [10] * 300
    rows = [(k, n, s) for s, more in (("a", 0), ("b", 1)) for k, n in enumerate([*sizes, *[5000] * more])]
    df = spark.createDataFrame(rows, "doc_id long, size long, source string")
    seen: dict = {}
    for seed in range(12):
        for r in systematic_mix(df, f"s{seed}", weights=(1, 5), share=0.8).where("size >= 200").collect():
            seen.setdefault((r["source"], r["doc_id"]), []).append((r["copies"], r["target"] / r["source_size"]))
    for found in seen.values():
        e = found[0][1]
        assert {c for c, _ in found} <= {math.floor(e), math.ceil(e)} and 0 < e < 2
        assert abs(sum(c for c, _ in found) / len(found) - e) < 0.45
    assert any(c for c, _ in seen["a", 1]) or any(c for c, _ in seen["a", 2])


def test_query_agrees_with_its_sql(spark, tmp_path):
    rows = [(k, *r[1:]) for k, r in enumerate(ROWS)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found, want = op7_mixing(spark, str(tmp_path)), db.sql(OP7_SQL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
