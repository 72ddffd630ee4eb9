import random
import re

import duckdb
import pytest

from loam.llm.licenses import OP10_SQL, PHRASES, TEMPLATES, Automaton, as_regex, mandatory, op10_licenses, parsed, scanned, trigger, words


def test_words():
    assert words("The MIT-License, v2.0 É\x7fa_b") == ["the", "mit", "license", "v2", "0", "É", "a", "b"]


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", {"mit-notice"}),
    ("released under the terms of the mit license", {"mit-notice"}),
    ("released under an mit license", set()),
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0-notice"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0-notice"}),
    ("This work is licensed under the GNU General Public License, version 2.", set()),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
    ("Licensed under Creative Commons Attribution 4.0", {"cc-by-4.0"}),
    ("", set()),
])
def test_notices(text, labels):
    assert Automaton(TEMPLATES).labels(words(text)) == labels


def test_whole_text_with_changed_words():
    full = " ".join(w for w in words(re.sub(r"\[\[.*?\]\]", "", TEMPLATES["mit-text"], flags=re.S)))
    a = Automaton(TEMPLATES)
    assert "mit-text" in a.labels(words(f"before Copyright (c) 2020 Some Body. {full} after"))
    assert "mit-text" not in a.labels(words(full.replace("sublicense", "license")))


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(2)
    for _ in range(300):
        m = " ".join(rng.choice(["a", "b", "[[a b]]", "{{a|b a|c}}", "{{2}}", "[[{{1}} c]]"]) for _ in range(rng.randint(1, 5))) + " b"
        a, r = Automaton({"x": m}), re.compile(f" {as_regex(parsed(m))}")
        for _ in range(20):
            w = [rng.choice("abc") for _ in range(rng.randint(0, 7))]
            assert bool(a.labels(w)) == bool(r.search(" " + "".join(x + " " for x in w))), (m, w)


def test_scan(spark):
    long = "word " * 100_000 + "mit license"
    rows = [(1, "MIT  LICENSE or the Apache-License; general public license MIT license"), (2, None), (3, ""), (4, long), (None, "no such thing"), (6, "mit. license"), (6, "mit. license"), (7, "mitlicense summit license")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = scanned(df).collect()
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert len(got) == len(rows)
    assert by[1] == (11, 4, 0, 9, "apache,gpl,mit", "apache,gpl,mit", 0.5)
    assert by[2] == by[3] == (0, 0, None, None, "", "", 0.0)
    assert by[4][:4] == (100_002, 1, 100_000, 100_000)
    assert by[6] == (2, 1, 0, 0, "mit", "mit", 0.5) and by[7] == (3, 0, None, None, "", "", 0.0)
    assert set(PHRASES.values()) == {"mit", "apache", "gpl"}
    assert scanned(df.limit(0)).count() == 0


def one_wording(steps, rng):
    """Words of a text that the steps match, drawn among the wordings."""
    out = []
    for step in steps:
        if isinstance(step, str):
            out.append(step)
        elif step[0] == "any":
            out += rng.choices(["some", "body"], k=rng.randint(0, step[1]))
        else:
            out += one_wording(rng.choice(step[1]), rng)
    return out


@pytest.mark.parametrize("label", TEMPLATES)
def test_every_template_matches_its_wordings_and_passes_the_trigger(label):
    rng, a, steps = random.Random(1), Automaton(TEMPLATES), parsed(TEMPLATES[label])
    found = re.compile(trigger(TEMPLATES, PHRASES).replace("\\Q", "").replace("\\E", ""))
    for _ in range(20):
        w = one_wording(steps, rng)
        assert label in a.labels(["x", *w, "y"]) and found.search(" ".join(w).upper())
        need = [k for k, x in enumerate(w) if w.count(x) == 1 and x in mandatory(steps)]
        k = rng.choice(need)
        assert label not in a.labels([*w[:k], "qqq", *w[k + 1 :]])


def test_templates_without_common_words(spark):
    df = spark.createDataFrame([(1, "Qu\u00e9 dice aqu\u00ed"), (2, "one two"), (3, "nothing"), (4, "x 9 y")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in scanned(df, {"a": "dice [[no]] aqu\u00ed", "b": "{{one|two}} two"}).collect()}
    assert got == {1: "a", 2: "b", 3: "", 4: ""}
    assert trigger({"c": "{{x|y}} {{2}}"}, {}) is None
    got = {r["doc_id"]: r["labels"] for r in scanned(df, {"c": "{{x|y}} {{1}} {{y|z}}"}, {}).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "c"}
    assert {r["labels"] for r in scanned(df, {}, {}).collect()} == {""}


def test_query_agrees_with_its_sql(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(one_wording(parsed(m), rng)) + ". MIT License" * (k % 2) for k, m in enumerate(TEMPLATES.values())]
    rows = [(9000 + k, t) for k, t in enumerate([*texts, None, "", "general public license " * 3, "word " * 50_000 + "Apache License"])]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    docs.withColumn("labels", docs["doc_id"]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found, want = op10_licenses(spark, str(tmp_path)), db.sql(OP10_SQL)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
