"""License scan by templates: markup with optional and replaceable regions, compiled to automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Words of a text whose A-Z are lower-case, and the same without lower-casing it first.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}



def read_templates() -> dict[str, str]:
    """Label to template of the folder `templates`: a file each, or several short ones in the lines of notices.txt.

    In a template [[...]] may be missing; {{n}} stands for up to n words of any kind; {{a|b c}} for one of the wordings.
    """
    found = {}
    for f in sorted(files(__package__).joinpath("templates").iterdir(), key=lambda f: f.name):
        if f.name == "notices.txt":
            found |= dict(line.split(" = ", 1) for line in f.read_text(encoding="utf-8").splitlines() if line)
        elif f.name.endswith(".txt"):
            found[f.name.removesuffix(".txt")] = f.read_text(encoding="utf-8")
    return found


TEMPLATES = read_templates()


def words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(LOWER))


def parsed(markup: str) -> list:
    """Nested steps of a template: a word, ("any", n), ("one", [steps, ...])."""
    tokens = re.findall(r"\[\[|\]\]|\{\{.*?\}\}|" + WORD, markup.translate(LOWER), re.S)

    def run(at: int) -> tuple[list, int]:
        steps: list = []
        while at < len(tokens):
            t = tokens[at]
            if t == "]]":
                return steps, at
            if t == "[[":
                inner, at = run(at + 1)
                steps.append(("one", [inner, []]))
            elif t.startswith("{{"):
                body = t[2:-2]
                steps.append(("any", int(body)) if body.isdigit() else ("one", [words(x) for x in body.split("|")]))
            else:
                steps.append(t)
            at += 1
        return steps, at

    return run(0)[0]


def mandatory(steps: list) -> set[str]:
    """Words that every text which matches these steps has."""
    found: set[str] = set()
    for step in steps:
        if isinstance(step, str):
            found.add(step)
        elif step[0] == "one":
            found |= set.intersection(*map(mandatory, step[1])) if step[1] else set()
    return found


def trigger(templates: dict[str, str], phrases: dict[str, str]) -> str | None:
    """A pattern that finds something in every text with a place of any of them: a few words, one of which each must have.

    None where one has no word that all its wordings share; then every text is to be read.
    """
    left = [mandatory(parsed(m)) for m in templates.values()] + [set(p.split()) for p in phrases]
    if not all(left):
        return None
    chosen = []
    while left:
        # long words are rarer; of those as long, the one that the most others need too
        best = max(set().union(*left), key=lambda w: (sum(any(w in y for y in x) for x in left) * len(w) ** 2, w))
        chosen.append(best)
        left = [x for x in left if not any(best in w for w in x)]
    return "(?i)" + "|".join("\\Q" + w + "\\E" for w in chosen) if chosen else "^\\b$"


class Automaton:
    """All templates as one automaton: for each state the states that a given word, or any word, leads to."""

    def __init__(self, templates: dict[str, str]):
        self.free: list[set[int]] = [set()]  # moves without a word
        self.by_word: list[dict[str, set[int]]] = [{}]
        self.by_any: list[set[int]] = [set()]
        self.accepts: dict[int, str] = {}
        for label, markup in templates.items():
            self.accepts[self._add(0, parsed(markup))] = label
        self.closed = [self._closure(s) for s in range(len(self.free))]
        self.start = self.closed[0]
        self.firsts = {w for s in self.start for w in self.by_word[s]}
        self.greedy = any(self.by_any[s] for s in self.start)

    def _state(self) -> int:
        self.free.append(set())
        self.by_word.append({})
        self.by_any.append(set())
        return len(self.free) - 1

    def _add(self, at: int, steps: list) -> int:
        for step in steps:
            if isinstance(step, str):
                to = self._state()
                self.by_word[at].setdefault(step, set()).add(to)
                at = to
            elif step[0] == "any":
                ends = [at]
                for _ in range(step[1]):
                    to = self._state()
                    self.by_any[ends[-1]].add(to)
                    ends.append(to)
                at = self._state()
                for e in ends:
                    self.free[e].add(at)
            else:
                out = self._state()
                for branch in step[1]:
                    into = self._state()
                    self.free[at].add(into)
                    self.free[self._add(into, branch)].add(out)
                at = out
        return at

    def _closure(self, s: int) -> frozenset[int]:
        found, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()] - found:
                found.add(t)
                todo.append(t)
        return frozenset(found)

    def labels(self, text: list[str]) -> set[str]:
        """Labels of the templates that some run of words matches from end to end."""
        active: set[int] = set()
        found: set[str] = set()
        for w in text:
            begins = self.greedy or w in self.firsts
            if not active and not begins:
                continue
            following: set[int] = set()
            for s in active | self.start if begins else active:
                for t in self.by_word[s].get(w, ()):
                    following |= self.closed[t]
                for t in self.by_any[s]:
                    following |= self.closed[t]
            active = following
            found.update(self.accepts[s] for s in active if s in self.accepts)
        return found


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of rows (doc_id, text).

    Words are counted by Spark; only texts with one of the words that templates and phrases can't do without reach the
    automata, which read them whole, however long. score is 1 where a template's whole wording is there, 0.5 where only a
    phrase is, else 0. Null texts are empty and have no words; without places first_word and last_word are null and labels
    empty strings. Of places or labels that tie the smallest and largest are given, or all. Repeated rows, and rows of equal
    or no id, are scanned each; other columns, whatever their names, are left; an empty table gives an empty one.
    """
    lists = [(p.split(), label) for p, label in phrases.items()]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates)
        for b in batches:
            rows = []
            for text in b.column("text"):
                if not text.is_valid:
                    rows.append((0, None, None, "", "", 0.0))
                    continue
                w = words(text.as_py())
                places, base = [], set()
                for k, word in enumerate(w):
                    for phrase, label in lists:
                        if word == phrase[0] and w[k : k + len(phrase)] == phrase:
                            places.append(k)
                            base.add(label)
                more = automaton.labels(w)
                rows.append((len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    n = F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")
    needed = trigger(templates, phrases)
    some = F.col("text") if needed is None else F.when(F.col("text").rlike(needed), F.col("text"))
    sent = docs.select("doc_id", n.alias("n_words"), some.alias("text"))
    return sent.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the places of the base phrases and the labels of phrases and templates; a row each, as scanned has it.

    Null and empty texts have no words, places or labels; texts of any length are read whole; repeated rows are scanned
    each; other columns are left; an empty table gives no rows.
    """
    return scanned(table(spark, sf_dir, "documents"))


def as_regex(steps: list) -> str:
    """The same wording for a text whose words each end in one blank."""
    out = ""
    for step in steps:
        if isinstance(step, str):
            out += re.escape(step) + " "
        elif step[0] == "any":
            out += f"(?:[^ ]+ ){{0,{step[1]}}}"
        else:
            out += "(?:" + "|".join(as_regex(b) for b in step[1]) + ")"
    return out


def oracle() -> str:
    places = ", ".join(f"(CASE WHEN {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))} THEN i END)" for p in PHRASES)
    found = " ".join(f"+ len(list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(p.split()))}))" for p in PHRASES)
    anywhere = f"list_filter(range(1, len(w) + 1), lambda i: coalesce({places}) IS NOT NULL)"
    has = lambda x: f"contains(t, ' {x} ')"
    base = "[" + ", ".join(f"CASE WHEN {has(p)} THEN '{label}' END" for p, label in PHRASES.items()) + "]"
    more = "[" + ", ".join(f"CASE WHEN regexp_matches(t, ' {as_regex(parsed(m))}') THEN '{label}' END" for label, m in TEMPLATES.items()) + "]"
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL))), ',')"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
p AS (SELECT *, {anywhere} AS places, {base} AS base, {more} AS more FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(0 {found} AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  {joined("base")} AS base_labels, {joined("list_concat(base, more)")} AS labels,
  CAST(CASE WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 1 WHEN len(places) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM p
"""


OP10_SQL = oracle()
