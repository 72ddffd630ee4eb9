"""Stable ids: hashes of what a row is, so that the same input gets the same ids on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def seed_id(seed: Column) -> Column:
    return F.substring(F.md5(_text(seed)), 1, 24)


def title_id(seed: Column, title: Column) -> Column:
    return F.md5(F.concat(_text(seed), F.lit("||"), _text(title)))


def work_id(title: Column) -> Column:
    return F.substring(F.sha1(strip(_text(title))), 1, 24)


def record_id(seed: Column, url: Column, other: Column) -> Column:
    return F.sha1(F.concat_ws("|", _text(seed), _text(url), _text(other)))


def passage_id(doc: Column, section: Column, i: Column, text: Column) -> Column:
    return F.concat(F.substring(F.md5(F.concat_ws("|", _text(doc), _text(section), _text(i), _text(text))), 1, 24), F.lit("_"), _text(i))


def page_chunk_id(url: Column, i: Column, text: Column) -> Column:
    return F.concat(F.substring(F.md5(F.concat(_text(url), F.lit("#"), _text(i), F.lit("::"), _text(text))), 1, 24), F.lit("_"), _text(i))


def block_id(doc: Column, i: Column) -> Column:
    return F.concat(_text(doc), F.format_string("#b%04d", i))


def segment_id(doc: Column, i: Column) -> Column:
    return F.concat(_text(doc), F.lit(":"), _text(i))


def vector_id(doc: Column, section: Column, i: Column, prefix: str = "") -> Column:
    quoted = F.regexp_replace(F.url_encode(_text(section)), r"\+", "%20")
    return F.concat(F.lit(prefix + "|" if prefix else ""), _text(doc), F.lit("|"), quoted, F.lit("|"), _text(i))


def character_id(doc: Column, name: Column) -> Column:
    return F.concat(_text(doc), F.lit("|"), F.pmod(F.xxhash64(name), F.lit(65536)).cast("string"))
