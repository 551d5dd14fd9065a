"""Text expressions and patterns. Patterns are valid both in Java and in RE2, so an oracle can use them unchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One blank of any kind that occurs in citations (thin and no-break ones too).
WS = r"[\s\x{00A0}\x{2009}\x{202F}]"
NO_WS = r"[^\s\x{00A0}\x{2009}\x{202F}]"
#: Citation patterns. Range ends take up to four digits after the dot.
SINGLE = rf"(?i)§{{1,2}}{WS}*(\d{{1,3}}\.\d{{1,3}}[A-Za-z0-9\-]*(?:\([a-z0-9]+\))?)"
RANGE = rf"(?i)§§{WS}*(\d{{1,3}}\.\d{{1,4}}){WS}*(?:–|-|to|through){WS}*(\d{{1,3}}\.\d{{1,4}})"
RANGE_COMPAT = rf"(?i)§§{WS}*(\d{{1,3}}\.\d{{1,3}}){WS}*(?:–|-|to|through){WS}*(\d{{1,3}}\.\d{{1,3}})"
INWORD = rf"(?i)\bsections?{WS}+(\d{{1,3}}\.\d{{1,3}}[A-Za-z0-9\-]*)"
CFR_SECTION = rf"(?i)\b(\d+){WS}*CFR{WS}*§{{1,2}}{WS}*(\d{{1,3}}\.\d{{1,3}}[A-Za-z0-9\-]*)"
CFR_PART = rf"(?i)\b(\d+){WS}*CFR{WS}+part{WS}+(\d{{1,3}})\b"
SECTION_CUE = rf"\(§{WS}*\d+(?:\.\d+)?\)"
#: Line patterns of extracted pages.
HEADER_LINE = rf"(?i)^{WS}*§{WS}*(\d{{1,3}}\.\d{{1,3}}[A-Za-z0-9\-]*(?:\([a-z0-9]+\))*){WS}*(.*)$"
NOISE_LINE = r"(?i)^(Authority:|Source:|Editorial Note:|HISTORY:)"
NOISE_LINE_COMPAT = r"(?i)^(Authority:|Source:|Editorial Note:|HISTORY:)[\p{L}\p{N}_]"
PAGE_JUNK = r"(?i)^(VerDate|[0-9]{4}\s*CFR\s*.*|[0-9]+\s*\|\s*Page|\[\s*\d+\s*\])$"
#: Replacements of the frequent garbled sequences, in order.
GARBLED = (("Â§", "§"), ("â€”", "—"), ("â€“", "–"), ("â€˜", "‘"), ("â€™", "’"), ("â€œ", "“"), ("â€\x9d", "”"), ("â€ť", "”"), ("â€\x9c", "“"), ("â€", '"'))


def all_groups(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def trim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def squeeze_blanks(c: Column) -> Column:
    """One space for every run of blanks; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def word_list(c: Column) -> Column:
    """Words parted by blanks; none for null."""
    return F.when(squeeze_blanks(c) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.split(squeeze_blanks(c), " "), F.array().cast("array<string>")))


def token_count(c: Column) -> Column:
    """Words, at least 1."""
    return F.greatest(F.lit(1), F.size(F.split(squeeze_blanks(c), " ")))


def normalize_text(c: Column) -> Column:
    """Carriage returns dropped, words joined that a hyphen parts at a line end, blanks and blank lines collapsed."""
    s = F.regexp_replace(c, "\r", "")
    s = F.regexp_replace(s, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{2,}", "\n")
    return trim_blanks(s)


def fix_garbled(c: Column) -> Column:
    """The frequent garbled sequences replaced and blanks squeezed line by line."""
    for bad, good in GARBLED:
        c = F.replace(c, F.lit(bad), F.lit(good))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+\n", "\n"), r"\n\s+", "\n"), r"^\s+|\s+$", "")


def citation_spacing(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\({WS}*§{WS}*", "(§"), rf"{WS}+\)", ")")


def word_cap(c: Column, words: int) -> Column:
    """Text of at most so many words unchanged; else its first ones, cut back to a sentence end if that costs 40 characters at most."""
    w = word_list(c)
    cut = F.array_join(F.slice(w, 1, words), " ")
    ended = F.regexp_extract(cut, r"(?s)^(.+[.!?])[^.!?]*$", 1)
    return F.when(F.size(w) <= words, c).when((ended != "") & (F.length(cut) - F.length(ended) <= 40), ended).otherwise(cut)


def expand_range(a: Column, b: Column, most: int = 500) -> Column:
    """All ids from a to b (``37.3``, ``37.7``) of one part; both ends if they are no such range."""
    pa, pb = F.substring_index(a, ".", 1), F.substring_index(b, ".", 1)
    m, n = F.substring_index(a, ".", -1).cast("int"), F.substring_index(b, ".", -1).cast("int")
    fits = (pa == pb) & (n >= m) & (n - m <= most)
    steps = F.when(fits, F.sequence(m, F.when(fits, n).otherwise(m)))
    return F.when(fits, F.transform(steps, lambda k: F.concat(pa, F.lit("."), k))).otherwise(F.array(a, b))
