"""Chunking. Fixed windows are built-in expressions; packers that carry state from sentence to sentence are Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .noise import is_noise_line
from .text import bound, clean, clean_plain, strip

SENTENCE = re.compile(r"((?:[.!?…]|[다요죠네]\.)[\"'」』)]*)\s+")
PARAGRAPH = re.compile("\n\n+")
CLAUSE = re.compile(r",|;| (?:그러나|하지만|그리고|또한) ")


def windows(c: Column, size: int = 1600, overlap: int = 150) -> Column:
    """Windows of `size` signs of which neighbours share `overlap`; the last one ends with the text. Empty texts have none."""
    step = size - overlap

    def cut(t: Column) -> Column:
        n = F.length(t)
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(t, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return bound(c, cut)


def labelled_windows(c: Column, section: Column, size: int = 1600, overlap: int = 150) -> Column:
    return F.transform(windows(clean_plain(c), size, overlap), lambda x: with_header(section, x))


def token_windows(c: Column, tokens: int = 480, stride: int = 120) -> Column:
    """Windows by a rule of thumb of three signs a token, with their part's label."""
    return F.transform(windows(clean_plain(c), tokens * 3, stride * 3), lambda x, i: F.struct(x.alias("text"), F.format_string("part-%d", i).alias("part")))


def with_header(section: Column, c: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("["), section, F.lit("] "), c)).otherwise(c)


def with_title(title: Column, section: Column, c: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("] · ["), section, F.lit("]\n"), c)


def korean_sentences(text: str, most: int = 900) -> list[str]:
    out = []
    for block in PARAGRAPH.split(text):
        for s in SENTENCE.sub("\\1\n", block.strip()).split("\n"):
            s = s.strip()
            parts = CLAUSE.split(s) if len(s) > most * 1.2 else [s]
            out += [p for x in parts if (p := x.strip())]
    return out


def pack_sentences(text: str, least: int = 450, most: int = 900, overlap: int = 120) -> list[str]:
    """Whole sentences up to `most` signs; a full chunk's last sentences, `overlap` signs at least, begin the next one."""
    done: list[str] = []
    held: list[str] = []
    size = 0
    for s in korean_sentences(text, most):
        need = len(s) + bool(held)
        if size + need > most:
            done.append(" ".join(held).strip())
            if size < least:
                held, size = [s], len(s)
                continue
            k, back = len(held), 0
            while k and back < overlap:
                k -= 1
                back += len(held[k]) + 1
            held, size, need = held[k:], back, len(s) + 1
        held.append(s)
        size += need
    if held:
        rest = " ".join(held).strip()
        if done and len(rest) < least // 2:
            done[-1] = f"{done[-1]} {rest}".strip()
        else:
            done.append(rest)
    return done


def pack_with_tail(text: str, least: int = 750, most: int = 900, overlap: int = 120) -> list[str]:
    """Sentences up to `most` signs; the last `overlap` signs of a full chunk begin the next one."""
    done: list[str] = []
    held: list[str] = []
    size = 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?…])\s+", text)):
        if not s:
            continue
        if size + len(s) + 1 > most:
            full = " ".join(held)
            done.append(full)
            tail = full[-overlap:] if size >= least and 0 < overlap < len(full) else None
            held, size = ([tail], len(tail)) if tail is not None else ([], 0)
        held.append(s)
        size += len(s) + 1
    done.append(" ".join(held))
    return [x.strip() for x in done if x.strip()]


def stitched(lines: list[str], least: int = 80) -> list[str]:
    """Short lines joined until they have `least` signs, one for each blank counted; long ones stand alone."""
    done: list[str] = []
    held: list[str] = []
    size = 0
    for x in lines:
        whole = len(x) >= least
        if not whole:
            held.append(x)
            size += len(x) + 1
        if held and (whole or size >= least):
            done.append(" ".join(held))
            held, size = [], 0
        if whole:
            done.append(x)
    return [*done, " ".join(held)] if held else done


def merged(chunks: list[str], target: int = 240, most: int = 2200) -> list[str]:
    """Chunks joined by line ends while under `target` signs together; what is longer than `most` is split at sentences."""
    joined: list[str] = []
    held: list[str] = []
    size = 0
    for c in chunks:
        if size + len(c) < target:
            held.append(c)
            size += len(c) + 2
            continue
        if held:
            joined.append("\n".join(held))
        joined.append(c)
        held, size = [], 0
    if held:
        joined.append("\n".join(held))
    out: list[str] = []
    for c in joined:
        if len(c) <= most:
            out.append(c)
            continue
        have = ""
        for part in re.split(r"(?<=[。！？!?.])\s+", c):
            if len(have) + len(part) + 1 > most:
                if have:
                    out.append(have.strip())
                have = part
            else:
                have = f"{have} {part}" if have else part
        if have:
            out.append(have.strip())
    return out


def _over_texts(f):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f("" if x is None else x))

    return run


def _over_lists(f):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f([] if x is None else list(x)))

    return run


def sentence_chunks(c: Column, least: int = 450, most: int = 900, overlap: int = 120, keep_paragraphs: bool = False) -> Column:
    """Chunks of whole sentences. White space is squashed first, which leaves one paragraph, unless keep_paragraphs."""
    c = F.coalesce(c, F.lit("")) if keep_paragraphs else clean_plain(c)
    return _over_texts(lambda t: pack_sentences(t, least, most, overlap))(c)


def sentences(c: Column) -> Column:
    return _over_texts(korean_sentences)(c)


def tail_chunks(c: Column, least: int = 750, most: int = 900, overlap: int = 120) -> Column:
    return _over_texts(lambda t: pack_with_tail(t, least, most, overlap))(c)


def stitch_short(lines: Column, least: int = 80) -> Column:
    return _over_lists(lambda x: stitched(x, least))(lines)


def merge_small(chunks: Column, target: int = 240, most: int = 2200) -> Column:
    return _over_lists(lambda x: merged(x, target, most))(chunks)


def clean_lines(c: Column, normal_form: bool = True) -> Column:
    """Cleaned lines of a text that aren't noise. NFKC runs once on the whole text, line ends kept apart."""
    lines = F.split(F.coalesce(c, F.lit("")), r"[\r\n]+")
    if normal_form:
        lines = F.split(clean(F.array_join(lines, "\ue000"), True), "\ue000")
    else:
        lines = F.transform(lines, lambda x: clean(x, False))
    return F.filter(F.transform(lines, strip), lambda x: (x != "") & ~is_noise_line(x))


def paragraphs(blocks: Column, least: int = 40, most: int = 8000) -> Column:
    """A text of blocks: noise lines out, blocks under `least` signs out, joined by empty lines, the first `most` signs."""
    kept = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, r"[\r\n]+"), lambda x: clean(x, False)), lambda x: ~is_noise_line(x)), "\n"))
    return F.substring(F.array_join(F.filter(kept, lambda b: F.length(b) >= least), "\n\n"), 1, most)


def line_chunks(c: Column, least: int = 50, most: int = 300) -> Column:
    """Lines of at least `least` signs, in pieces of `most`, of which those of `least` stay, each once."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\r\n]+"), strip), lambda x: F.length(x) >= least)
    parts = F.flatten(F.transform(lines, lambda x: windows(x, most, 0)))
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda x: F.length(x) >= least))


def context_text(items: Column, each: int = 1200, whole: int = 6000) -> Column:
    """Numbered sources for a prompt from array<struct<title, section, text>>: texts cut at `each` signs, items until `whole` is passed."""
    shown = F.transform(items, lambda x, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["title"], F.lit("")), F.lit(" · "), F.coalesce(x["section"], F.lit("")), F.lit("\n"), F.substring(F.coalesce(x["text"], F.lit("")), 1, each)))
    ends = F.transform(shown, lambda x, i: F.aggregate(F.slice(shown, F.lit(1), i + 1), F.lit(0), lambda n, s: n + F.length(s)))
    over = F.transform(ends, lambda e: e > whole)
    first = F.array_position(over, True)
    return F.array_join(F.when(first > 0, F.slice(shown, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(shown), "\n\n")
