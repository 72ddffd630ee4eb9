"""HTML by the standard library's parser: page text, the best block, links and page kinds, in one Arrow pass a page."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = {"aside", "script", "style", "footer", "header", "nav", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"div", "table"}


class Page(HTMLParser):
    """Collects text outside of page furniture, the text of each div and table, links and headings."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[str] | None]] = []
        self.text: list[str] = []
        self.blocks: list[str] = []
        self.links: list[tuple[str, str, str]] = []
        self.headings: list[str] = []
        self.link: tuple[str, str, list[str]] | None = None
        self.heading: list[str] | None = None
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def _shut(self) -> None:
        tag, _, parts = self.open.pop()
        if parts is not None:
            text = "\n".join(parts).strip()
            if text:
                self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        dropped = tag in DROPPED or (tag == "div" and bool(re.search(r"(?:^|[\s_\-])ads?(?:[\s_\-]|$)", a.get("class") or "")))
        dropped = dropped or (bool(self.open) and self.open[-1][1])
        self.open.append((tag, dropped, [] if tag in BLOCKS and not dropped else None))
        if tag == "a" and a.get("href"):
            self.link = (a["href"], a.get("title") or "", [])
        if re.fullmatch(r"h[1-6]", tag) and not dropped:
            self.heading = []

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            href, title, parts = self.link
            self.links.append((href, title.strip(), " ".join(parts).strip()))
            self.link = None
        if re.fullmatch(r"h[1-6]", tag) and self.heading is not None:
            self.headings.append(" ".join(self.heading).strip())
            self.heading = None
        if any(t == tag for t, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        piece = data.strip()
        if not piece:
            return
        if self.link:
            self.link[2].append(piece)
        if self.open and self.open[-1][1]:
            return
        self.text.append(piece)
        if self.heading is not None:
            self.heading.append(piece)
        for _, _, parts in self.open:
            if parts is not None:
                parts.append(piece)


LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("href", "title", "text")])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("best", T.StringType()), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(LINK))])


@F.pandas_udf(PAGE)
def parsed(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        p = Page(h or "")
        best = max((b for b in p.blocks if len(b) > 50), key=lambda b: len(b) + b.count("\n"), default="")
        rows.append(("\n".join(p.text), best, p.headings, [dict(zip(("href", "title", "text"), x)) for x in p.links]))
    return pd.DataFrame(rows, columns=["text", "best", "headings", "links"])


def absolute(base: Column, href: Column) -> Column:
    """href against the page's own address."""

    @F.pandas_udf(T.StringType())
    def join(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else urljoin(x or "", y) for x, y in zip(b, h)])

    return join(base, href)


@F.pandas_udf(T.StringType())
def unquoted(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unquote(x))


def child_section(href: Column, seed: Column, sections: tuple[str, ...]) -> Column:
    """The section that /w/seed/section links to, if it is one of `sections`; else null."""
    parts = F.split(F.regexp_extract(unquoted(href), r"^(?:https?://[^/]+)?/w/([^?#]*)", 1), "/")
    hit = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == seed) & F.get(parts, F.lit(1)).isin(*sections)
    return F.when(hit, F.get(parts, F.lit(1)))


def character_links(links: Column, most: int = 10) -> Column:
    """Links to one page each with a title, first of each title, at most `most` a page."""
    named = F.filter(links, lambda x: (x["title"] != "") & F.regexp_extract(x["href"], r"^(?:https?://[^/]+)?/w/([^/?#]+)$", 1).rlike("."))
    titles = F.transform(named, lambda x: x["title"])
    return F.slice(F.filter(named, lambda x, i: F.array_position(titles, x["title"]) == i + 1), 1, most)


class Strict(HTMLParser):
    """The smallest div or dl around the first link to a list of characters, and the links with titles in it."""

    def __init__(self, html: str, mark: str = r"/w/.+/등장인물"):
        super().__init__(convert_charrefs=True)
        self.mark, self.open, self.found, self.box, self.order = re.compile(mark), [], [], None, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        self.order += 1
        self.open.append((tag, self.order))
        if tag == "a" and a.get("href"):
            boxes = [n for t, n in self.open if t in ("div", "dl")]
            if self.box is None and self.mark.search(unquote(a["href"])):
                self.box = boxes[-1] if boxes else 0
            if a.get("title") is not None and re.fullmatch(r"/w/[^/]+", a["href"]):
                self.found.append((a["title"].strip(), a["href"], set(boxes)))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def links(self) -> list[tuple[str, str]]:
        """(title, href), the first of each title."""
        out: dict[str, str] = {}
        for title, href, boxes in self.found if self.box else []:
            if self.box in boxes:
                out.setdefault(title, href)
        return list(out.items())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("href", T.StringType())])))
def strict_character_links(html: pd.Series) -> pd.Series:
    """Titles and addresses of the links beside the first one that leads to a list of characters; none without such a link."""
    return html.map(lambda h: [{"title": t, "href": x} for t, x in Strict(h or "").links()])


def page_kind(url: Column, headings: Column, character_words: tuple[str, ...] = ("등장인물", "캐릭터")) -> Column:
    """"characters" if the address or a heading names a list of characters, "list" with many headings, else "page"."""
    found = F.lit(False)
    for w in character_words:
        found = found | F.contains(unquoted(F.coalesce(url, F.lit(""))), F.lit(w)) | F.exists(headings, lambda h: F.contains(h, F.lit(w)))
    return F.when(found, "characters").when(F.size(headings) >= 10, "list").otherwise("page")
