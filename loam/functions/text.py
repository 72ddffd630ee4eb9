"""Text expressions. All run inside the JVM but for NFKC and fuzzy matching, which are Arrow UDFs."""

from __future__ import annotations

import difflib
import json
import operator
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Invisible and odd blanks that count as a blank.
BLANKS = "".join(map(chr, [0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _matches(wanted: str, other: str) -> float:
    """Best ratio of the shorter text against equally long parts of the longer one."""
    short, long = sorted((wanted, other), key=len)
    if not short:
        return 0.0
    if len(short) == len(long):
        return difflib.SequenceMatcher(None, short, long).ratio()
    m = difflib.SequenceMatcher(None, short, long)
    starts = {max(b.b - b.a, 0) for b in m.get_matching_blocks()}
    return max(difflib.SequenceMatcher(None, short, long[k : k + len(short)]).ratio() for k in starts)


@F.pandas_udf(T.DoubleType())
def fuzzy(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 1: how well the shorter of two texts fits somewhere in the longer."""
    return pd.Series([None if x is None or y is None else _matches(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_fuzzy(a: pd.Series, many: pd.Series) -> pd.Series:
    """The best of fuzzy(a, b) over a list; 0 without any."""
    return pd.Series([None if x is None else max((_matches(x, y) for y in (() if ys is None else ys) if y is not None), default=0.0) for x, ys in zip(a, many)], dtype="float64")


#: White space of any kind.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f uses it; Spark would put the whole expression in each place."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(c, F.lit(SPACES))


def squashed(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column, normal_form: bool = True) -> Column:
    """Odd blanks to blanks, NFKC, runs of white space to one blank, stripped; null becomes empty."""
    c = F.translate(F.coalesce(c, F.lit("")), BLANKS, " " * len(BLANKS))
    return squashed(nfkc(c) if normal_form else c)


def clean_plain(c: Column) -> Column:
    """The older form: only the zero-width blank and the byte-order mark, no NFKC."""
    return squashed(F.translate(F.coalesce(c, F.lit("")), "\u200b\ufeff", "  "))


def search_key(c: Column, normal_form: bool = True) -> Column:
    """Lower case with nothing but letters and digits: titles and queries are compared by it."""
    return F.regexp_replace(F.lower(nfkc(c) if normal_form else c), r"(?U)[\s\W_]+", "")


def strip_invisible(c: Column) -> Column:
    """Zero-width signs out, blanks and tabs to one blank, at most one empty line in a row."""
    c = F.regexp_replace(c, "[\u200b-\u200d\ufeff]", "")
    c = F.regexp_replace(c, "[ \t\u00a0]+", " ")
    return strip(F.regexp_replace(c, "\n\n\n+", "\n\n"))


def deleted(c: Column, patterns: list[str]) -> Column:
    """c without what the patterns match, one after the other. A pattern is spared the texts that don't hold what it needs (NEEDS)."""

    def without(t: Column, p: str) -> Column:
        needs = NEEDS.get(p, ())
        if not needs:
            return F.regexp_replace(t, p, "")

        def judged(x: Column) -> Column:
            may = bound(F.lower(x), lambda low: reduce(operator.or_, [F.contains(low, F.lit(n)) for n in needs]))
            return F.when(may, F.regexp_replace(x, p, "")).otherwise(x)

        return bound(t, judged)

    def cleaned(t: Column, some: list[str]) -> Column:
        for p in some:
            t = without(t, p)
        return t

    plain = [p for p in patterns if p not in HANGUL]
    return bound(c, lambda t: F.when(t.rlike("[가-힣]"), cleaned(t, patterns)).otherwise(cleaned(t, plain)))


#: Page furniture by family: legal lines, site names, feeds, phones and domains, shop talk, leftovers.
FURNITURE = [
    r"(?im)이 저작물은\s*CC.*?제외\)", r"(?im)namu\.wiki", r"(?im)powered by \S+ engine|impulsado por.*$", r"(?im)operado por .*$", r"(?im)hecho con .*$",
    r"(?im)su zona horaria es\s*[\w/\-]+", r"(?im)(?:this site is protected by re|h)captcha.*", r"(?im)apply\.", r"(?im)^\s*[()\w./·\-]+\s*[0-9]+[분초] 전\s*$",
    r"\b[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}\b", r"(?im)\bwww\.[\w.\-]+\b", r"(?im)\b[\w\-]+\.(?:kr|com|net)\b", "견적문의|서비스요금|체인점찾기|게시대 위치|오프라인광고",
    r"무이자할부|당일발송|데이터복구|전국\s*무료?출장", "더 보기", r"(?im)privacy policy|terms of (?:use|service)|t[eé]rminos(?: de uso)?|cont[aá]ctenos",
]
HEADLINES = [
    r"(?m)^(?:\"[^\"]{5,150}\"|“[^”]{5,150}”|‘[^’]{5,150}’)\s*(?:\.|…).*$", r"\[(?:공식|단독|속보|영상|오피셜|인터뷰|종합|포토|현장)\]", r"단독\s*보도|현장\s*취재|종합2?보", "기자|앵커|뉴시스|연합뉴스|일간스포츠|마이데일리",
    r"(?m)^\s*(?:中|日|独|獨|美|英|韓)\s?\S\S.*$", r"(?m)^(?=[^。\n]{7,400}$).{5,200}?(?:\.\.|\.…|…\.|……).*$",
]
LEFTOVERS = [r"(?im)^and the google$", r"(?m)^\s*(?:편집|\[편집\])\s*$", r"(?im)^\s*happy new year\s*$", r"(?im)^\s*qna\s*[:：]?\s*$", r"(?i)recaptcha"]
LICENSE_SPANS = [
    r"(?i)(?:©|ⓒ|\(c\)).*", r"저작권.*(?:보유|소유)", r"(?i)all\s+rights\s+reserved", "재방송|방영|방송(?:일|시간)", r"\d{4}(?:\.\s?\d{1,2}){2}", r"\d{4}년\s?\d{1,2}월\s?\d{1,2}일",
    r"(?i)amazon\s+prime|crunchyroll|funimation|hulu|netflix", r"(?i)youtube|tiktok|twitter|facebook|인스타그램", "넷플릭스|디즈니\\+?|라프텔|애니플러스|왓챠|쿠팡플레이|티빙", "성우\\s?[가-힣]+", r"(?:감독|각본|연출|원작|작화|제작)\s?:?.*",
    "콜라보(?:레이션)?|이벤트|캠페인|프로모션|행사", r"한정\s?(?:판|수량)|사은품|사인회|전시회|특전", r"(?i)\bost\b|엔딩|오프닝|[eo][dp]\s?테마", "♪.*|가사.*|노래.*", "작곡|작사|편곡", r"(?i)굿즈|블루레이|피규어|앨범|dvd|cd\b", r"(?i)xbox|steam|switch|닌텐도|플레이스테이션", r"(?i)https?://\S+|www\.\S+",
    "이 문서의 내용 중.*", "에 따라 이용할 수 있습니다.*", "기여하신 문서의.*", "나무위키는.*", "이 문서가 설명하는.*",
]


#: Patterns all of whose alternatives hold a Korean sign; texts without one are spared them.
HANGUL = {*(FURNITURE[k] for k in (0, 8, 12, 13, 14)), *HEADLINES[1:4], LEFTOVERS[1], *(LICENSE_SPANS[k] for k in (1, 3, 5, 8, 9, 10, 11, 12, 15, 19, 20, 21, 22, 23))}
#: Strings, in lower case, one of which a text must hold for a pattern to match.
NEEDS = {
    FURNITURE[1]: ("namu.wiki",), FURNITURE[2]: ("powered by", "impulsado por"), FURNITURE[3]: ("operado por",), FURNITURE[4]: ("hecho con",), FURNITURE[5]: ("zona horaria",),
    FURNITURE[6]: ("captcha",), FURNITURE[7]: ("apply.",), FURNITURE[9]: ("-",), FURNITURE[10]: ("www.",), FURNITURE[11]: (".kr", ".com", ".net"), FURNITURE[15]: ("privacy", "terms of", "rminos", "ctenos"),
    HEADLINES[0]: ('"', "“", "‘"), HEADLINES[4]: tuple("中日独獨美英韓"), HEADLINES[5]: ("..", "…"),
    LEFTOVERS[0]: ("and the google",), LEFTOVERS[2]: ("happy new year",), LEFTOVERS[3]: ("qna",), LEFTOVERS[4]: ("recaptcha",),
    LICENSE_SPANS[0]: ("©", "ⓒ", "(c)"), LICENSE_SPANS[2]: ("reserved",), LICENSE_SPANS[4]: (".",), LICENSE_SPANS[6]: ("prime", "crunchyroll", "funimation", "hulu", "netflix"),
    LICENSE_SPANS[7]: ("youtube", "tiktok", "twitter", "facebook", "인스타그램"), LICENSE_SPANS[13]: ("ost", "엔딩", "오프닝", "테마"), LICENSE_SPANS[14]: ("♪", "가사", "노래"),
    LICENSE_SPANS[16]: ("굿즈", "블루레이", "피규어", "앨범", "dvd", "cd"), LICENSE_SPANS[17]: ("xbox", "steam", "switch", "닌텐도", "플레이스테이션"), LICENSE_SPANS[18]: ("http", "www."),
}


def without_furniture(c: Column, short: int = 30, share: float = 0.6) -> Column:
    """c without page furniture; empty if at least `share` of its lines have `short` signs or fewer, as lists of links have."""

    def judged(t: Column) -> Column:
        lines = F.split(t, r"\r\n|\r|\n")
        few = F.size(F.filter(lines, lambda x: F.length(strip(x)) <= short)) / F.size(lines)
        return F.when((t != "") & (few >= share), "").otherwise(strip(t))

    return bound(deleted(strip_invisible(c), FURNITURE), judged)


def without_headlines(c: Column) -> Column:
    """c without what reads like a headline: by pattern, or short with several brackets, quotes or dots."""
    c = deleted(c, HEADLINES)
    lines = F.filter(F.split(c, r"\r\n|\r|\n"), lambda x: strip(x) != "")
    plain = F.filter(lines, lambda x: ~((F.length(strip(x)) <= 120) & (F.regexp_count(x, F.lit(r"""["“”‘’'…\[\]()【】<>]""")) >= 2) & x.rlike(r"[…\[\]()]")))
    return strip(F.array_join(plain, "\n"))


def clean_chunk(c: Column) -> Column:
    """Leftovers, then furniture, then headlines out of a chunk."""
    return strip(without_headlines(without_furniture(deleted(strip_invisible(c), LEFTOVERS))))


def without_license_spans(c: Column) -> Column:
    return squashed(deleted(c, LICENSE_SPANS))


def without_citations(c: Column) -> Column:
    """Without [12] and the blanks around."""
    return squashed(F.regexp_replace(c, r"\[\d+\]", ""))


def without_symbols(c: Column) -> Column:
    return squashed(F.regexp_replace(F.regexp_replace(c, r"[!@#$%^&*~★☆♥♡†◎●○■□▲△▼▽:;,.?'\"`|\\/+=<>\[\]{}_\-]", ""), r"\(\s*\)", ""))


def title_of_path(c: Column) -> Column:
    """Last part of a path, percent-decoded, without a bracketed end."""
    raw = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\+", "%2B")
    return strip(F.regexp_replace(F.coalesce(F.try_url_decode(raw), F.element_at(F.split(c, "/"), -1)), r"\s*\([^()]*\)\s*$", ""))


def without_inline_brackets(c: Column) -> Column:
    return squashed(F.regexp_replace(c, r"\([^()]*\)", " "))


def href_target(c: Column) -> Column:
    """A link without fragment and query."""
    return F.regexp_extract(c, r"^[^#?]*", 0)


def domain_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)https?://([^/]+)", 1))


def _kept(c: Column, other: str) -> Column:
    """How many signs are left without runs of others: counting matches one by one makes a string of each."""
    return F.length(F.regexp_replace(c, other, ""))


def latin_ratio(c: Column) -> Column:
    """ASCII letters among all signs; 1 for an empty text."""
    return F.when(F.length(c) > 0, _kept(c, "[^A-Za-z]+") / F.length(c)).otherwise(1.0)


def latin_share(c: Column) -> Column:
    """ASCII letters among letters; 0 without letters."""
    letters = _kept(c, r"\P{L}+")
    return F.when(letters > 0, _kept(c, "[^A-Za-z]+") / letters).otherwise(0.0)


def url_ratio(c: Column) -> Column:
    """Starts of URLs among blank-separated words; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"https?://|www\.")) / (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)).otherwise(0.0)


def query_variants(q: Column, aliases: dict[str, list[str]], normal_form: bool = True) -> Column:
    """The query, its key, and the aliases of every name it contains; of two signs at least, each once."""
    more = [F.when(F.contains(q, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in aliases.items()]
    found = F.concat(F.array(q, search_key(q, normal_form)), *more)
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: F.length(x) >= 2))


def title_aliases(title: Column, seed: Column) -> Column:
    """Spellings under which a title may be asked for: as it is, without brackets, blanks or symbols."""
    forms = []
    for c in (title, seed):
        bare = without_inline_brackets(c)
        forms += [c, bare, F.regexp_replace(c, r"(?U)\s+", ""), without_symbols(c), F.regexp_replace(c, r"[^0-9A-Za-z가-힣]", "")]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (F.length(x) >= 2)))


def made_queries(title: Column, aliases: Column, endings: tuple[str, ...] = ("요약", "줄거리", "등장인물")) -> Column:
    """Queries made of a row: its title, that with each ending, and its first two aliases."""
    made = F.concat(F.array(title), *[F.array(F.concat_ws(" ", title, F.lit(e))) for e in endings], F.slice(F.coalesce(aliases, F.array().cast("array<string>")), 1, 2))
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull() & (strip(x) != "")))


def bullets(c: Column, most: int = 5) -> Column:
    """Lines without their list marks, the first `most`."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:[-*•·▪]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def _balanced(text: str) -> str | None:
    """The first {...} of a text whose brackets match, strings apart."""
    begin = text.find("{")
    depth, quoted, k = 0, False, begin
    while 0 <= k < len(text):
        c = text[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[begin : k + 1]
        k += 1
    return None


def _salvaged(text: str) -> str:
    """What can still be read of damaged JSON, as JSON: the first whole object, else the keys whose values are whole."""
    block = _balanced(text)
    if block:
        try:
            return json.dumps(json.loads(block), ensure_ascii=False)
        except ValueError:
            pass
    string = r'"((?:[^"\\]|\\.)*)"'
    out: dict = {}
    for key, items in re.findall(r'"(\w+)"\s*:\s*\[([^\]]*)(?:\]|$)', text):
        out.setdefault(key, re.findall(string, items))
    for key, value in re.findall(r'"(\w+)"\s*:\s*' + string, text):
        out.setdefault(key, value)
    for key, value in re.findall(r'"(\w+)"\s*:\s*(-?\d+(?:\.\d+)?)', text):
        out.setdefault(key, float(value) if "." in value else int(value))
    return json.dumps(out, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def salvaged(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _salvaged(x))


def repaired_json(c: Column, schema: str) -> Column:
    """What a model wrote as JSON, in the schema: fences, typographic quotes, comments, trailing commas and bare keys are mended;
    of what still isn't JSON the first whole object counts, else the keys whose values are whole."""
    t = F.regexp_replace(c, r"(?s)^.*?```(?:json)?\s*(.*?)```.*$", "$1")
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    t = F.when(inner != "", inner).otherwise(t)
    t = F.translate(t, "“”„‟‘’", "\"\"\"\"''")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[\s,{])//.*$", "$1")
    t = F.regexp_replace(t, r",(\s*[}\]])", "$1")
    t = F.regexp_replace(t, r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", '$1"$2"$3')
    single = {"mode": "PERMISSIVE", "allowSingleQuotes": "true"}
    first, second = F.from_json(c, schema, {"mode": "PERMISSIVE"}), F.from_json(t, schema, single)
    # single quotes aren't JSON, but the reader knows them: what it makes nothing of is left to be salvaged
    whole = lambda x: F.startswith(strip(x), F.lit("{")) & F.try_parse_json(x).isNotNull()
    good, mended = F.coalesce(whole(c), F.lit(False)), F.coalesce(whole(t) | whole(F.translate(t, "'", '"')), F.lit(False))
    rest = F.from_json(salvaged(F.when(~good & ~mended, t)), schema, single)
    return F.when(good, first).when(mended, second).otherwise(rest)
