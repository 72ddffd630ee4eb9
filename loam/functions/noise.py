"""Noise lines and blocks: families of patterns, each one alternation, so a text is matched inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, latin_ratio, latin_share, strip, url_ratio

#: What shops write; two of them make an advertisement.
SHOP_WORDS = sorted(
    "24시 A/S AS 견적 견적문의 구독 당일발송 대표 데이터복구 둔산동 리프팅 무료출장 무이자 문의 보톡스 본사 비만 상담 서비스요금 여드름 예약 오프라인광고 온라인문의 유성점 유성온천역 의원 전국 지점 진료 진료과목 체인점찾기 출장 치과 클리닉 특가 피부과 필러 한의원 할부 현수막 홈페이지접수".split()
    + ["당일 발송", "데이터 복구"]
)
FAMILIES = {
    "legal": r"(?i)©|all\s+rights\s+reserved|저작권.*(?:보유|소유)|이\s*저작물은",
    "captcha": r"(?i)protected by recaptcha|hcaptcha.*(?:terms|privacy policy)|apply\.|su zona horaria es",
    "wiki": r"나무위키는.*?(?:위키위키입니다|백과사전이\s*아니며)|더\s*보기|이전\s*역사|특수 기능|최근 (?:토론|변경)",
    "site": r"(?i)^(?:facebook|instagram|인스타그램|tiktok|twitter|youtube|x\b)\s?:?.*$",
    "stream": r"(?i)(?:넷플릭스|디즈니\+?|라프텔|애니플러스|왓챠|쿠팡플레이|티빙)\s?:?.*$",
    "press": r"(?U)(?:경향신문|기자|뉴스1?|단독|머니투데이|보도자료|속보|스포츠서울|신문|연합뉴스|조선일보|취재|한겨레)\b|(?:사진|영상|자료|출처)=|\[?(?:사설|오피니언|인터뷰|칼럼)\]?|(?:[日韓中]|일본|중국|한국)\s*언론",
    "moments": r"(?U)\b\d+\s*(?:초|분|시간)\s*전\b",
    "politics": r"(?U)(?:검찰|고발|국정농단|기소|대선|대통령실|수사|선거\s*개입|지선|청와대|총선|탄핵|특검|특별검사)\b|국민의힘|김건희|명태균|민주당|윤석열|이재명|한동훈|건진법사",
    "brand": r"(?i)대덕구\s*컴퓨터|오마이\s*(?:pc|피[씨시])",
    "place": r"(?U)/\s*(?:이전\s*역사|작중\s*행적|보러\s*가기|논란\s*및\s*사건[·\s]*사고)\b",
    "url": r"(?i)(?:https?://|www\.)[\w.\-가-힣]+\.[a-z]{2,}",
    "domain": r"(?iU)[\w\-]+(?:\.[\w\-]+)+(?:/|\b)",
    "phone": r"\b0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}\b",
}
GAMES = r"(?:CBT|OBT)\b"
GAMES_KOREAN = r"(?U)(?:대규모\s*업데이트|런칭|론칭|사전\s*등록|출시)\b|(?:그라비티|넥슨|넷마블|스마일게이트|엔씨소프트|카카오게임즈|펄어비스)\b|던전앤파이터|라그나로크|로스트아크|리니지|메이플스토리"
#: Names of sections and of sides of a work, which no character bears.
SECTION_NAMES = ("개요", "명대사", "방영", "설정", "세계관", "에피소드", "음악", "줄거리", "평가")


#: Families all of whose patterns hold a Korean or Chinese sign: texts without one are spared them.
KOREAN = {"wiki", "stream", "press", "moments", "politics", "brand", "place"}


def has_korean(c: Column) -> Column:
    return c.rlike("[가-힣日韓中]")


def shop_words(c: Column) -> Column:
    hits = lambda low: sum((F.contains(low, F.lit(w.lower())).cast("int") for w in SHOP_WORDS), F.lit(0))
    travel = F.contains(c, F.lit("출장")) & (F.contains(c, F.lit("무료")) | F.contains(c, F.lit("0원")))
    return (has_korean(c) | F.contains(F.lower(c), F.lit("a/s"))) & (travel | bound(F.lower(c), lambda low: hits(low) >= 2))


#: What a line must hold, in lower case, for a family to match: plain strings are found much faster than patterns.
NEEDLES = {"legal": ("©", "reserved", "저작"), "captcha": ("captcha", "apply.", "zona horaria"), "url": ("http", "www."), "domain": (".",), "phone": ("0",)}


def _may(c: Column, name: str) -> Column:
    """Whether a family may match: what it can't do without is there."""
    found = F.lit(name not in NEEDLES)
    for x in NEEDLES.get(name, ()):
        found = found | F.contains(c if x.upper() == x else F.lower(c), F.lit(x))
    return found & c.rlike(r"(?U)\.[\w\-]") if name == "domain" else found


def _any(c: Column, names: list[str]) -> Column:
    out, korean = F.lit(False), F.lit(False)
    for n in names:
        if n in KOREAN:
            korean = korean | c.rlike(FAMILIES[n])
        else:
            out = out | (_may(c, n) & c.rlike(FAMILIES[n]))
    return out | (has_korean(c) & korean)


def is_noise_line(c: Column, share: float = 0.82) -> Column:
    """Whether a line is noise; null and lines of under two signs are."""
    judged = lambda t: (F.length(t) < 2) | (latin_share(t) > share) | _any(t, list(FAMILIES)) | is_game_notice(t) | shop_words(t)
    return F.coalesce(bound(strip(c), judged), F.lit(True))


def is_noise_line_old(c: Column) -> Column:
    """The older test: families only at a line's start, no share of Latin letters."""

    def judged(t: Column) -> Column:
        anchored = korean = F.lit(False)
        for n in ("legal", "captcha", "wiki", "site", "stream", "press", "moments", "politics"):
            hit = t.rlike("(?iU)^(?:" + FAMILIES[n].removeprefix("(?i)").removeprefix("(?U)").replace("^", "") + ")")
            anchored, korean = (anchored, korean | hit) if n in KOREAN else (anchored | hit, korean)
        return (F.length(t) < 2) | anchored | (has_korean(t) & korean) | _any(t, ["url", "domain", "phone"]) | shop_words(t)

    return F.coalesce(bound(strip(c), judged), F.lit(True))


def is_noise_block(c: Column) -> Column:
    """Whether a stitched paragraph is noise: as for a line, but for game notices and Latin letters."""
    return F.coalesce(bound(strip(c), lambda t: (t == "") | _any(t, list(FAMILIES)) | shop_words(t)), F.lit(True))


def is_light_noise(c: Column) -> Column:
    return F.coalesce((F.length(c) < 10) | (latin_ratio(c) > 0.7) | F.contains(F.lower(c), F.lit("google")) | F.contains(c, F.lit("日 언론")), F.lit(True))


def is_game_notice(c: Column) -> Column:
    return c.rlike(GAMES) | (has_korean(c) & c.rlike(GAMES_KOREAN))


def is_low_quality(c: Column, domain: Column, wiki: str = "namu.wiki") -> Column:
    """Chunks without letters or digits, or with too many Latin letters or URLs; pages of the wiki are allowed more."""
    own = F.contains(F.coalesce(domain, F.lit("")), F.lit(wiki))
    return ~c.rlike("[0-9A-Za-z가-힣]") | (latin_ratio(c) > F.when(own, 0.90).otherwise(0.80)) | (url_ratio(c) > F.when(own, 0.25).otherwise(0.15))


def has_keyword(words: list[str], *columns: Column) -> Column:
    """Whether a word is in one of the columns: keeps a document that cleaning has emptied."""
    found = F.lit(False)
    for c in columns:
        for w in words:
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower()))
    return found


def is_no_character(name: Column) -> Column:
    t = F.lower(strip(name))
    inside = F.lit(False)
    for n in SECTION_NAMES:
        inside = inside | F.contains(name, F.lit(n))
    return F.coalesce((t == "") | F.contains(name, F.lit("/")) | t.isin(*SECTION_NAMES) | inside, F.lit(True))


def is_character_page(title: Column, parent: Column, depth: Column, seed: Column, parts: tuple[str, ...] = ("등장인물", "캐릭터")) -> Column:
    """A page under a list of characters, or two links from its seed with a title that names no section."""
    under = F.lit(False)
    for p in parts:
        under = under | F.contains(F.coalesce(parent, F.lit("")), F.lit(p))
    return under | ((depth >= 2) & (title != seed) & ~is_no_character(title))
