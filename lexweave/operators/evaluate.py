"""Measures of summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t


def cue_count(c: Column) -> Column:
    return F.size(t.all_groups(F.coalesce(c, F.lit("")), t.SECTION_CUE, 0))


def words(c: Column) -> Column:
    return F.size(t.word_list(c))


def trigram_redundancy(c: Column) -> Column:
    """Share of three-word runs that occurred before, words as they are written; 0 below three words."""
    def share(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 2)), lambda i: F.array_join(F.slice(w, i, 3), " "))
        return F.when(F.size(w) < 3, 0.0).otherwise(1 - F.size(F.array_distinct(runs)) / F.size(runs))

    return F.element_at(F.transform(F.array(t.word_list(c)), share), 1)


def mojibake_flag(c: Column) -> Column:
    return F.coalesce(c.rlike("Â§|â€"), F.lit(False))


def coverage(plan: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc_id, coverage, coverage_strict): percent of plan ids that the blank-free summary contains; strict: not as part of a longer number."""
    s = summaries.select("doc_id", F.regexp_replace(F.coalesce("summary_text", F.lit("")), rf"{t.WS}+", "").alias("s"))
    j = plan.select("doc_id", F.regexp_replace("sec_id", rf"{t.WS}+", "").alias("id")).join(s, "doc_id")
    j = j.withColumn("hit", F.contains("s", "id")).withColumn("strict", F.expr("regexp_like(s, concat('\\\\Q', id, '\\\\E(?![0-9])'))"))
    pct = lambda c: F.avg(F.col(c).cast("double")) * 100
    return j.groupBy("doc_id").agg(pct("hit").alias("coverage"), pct("strict").alias("coverage_strict"))


_VOWELS = "aeiou"


def porter_stem(w: str) -> str:
    """The Porter stem of a lower-case word (words of up to three letters stay, as usual for this measure)."""
    if len(w) <= 3:
        return w

    def cons(s: str, i: int) -> bool:
        return s[i] not in _VOWELS and not (s[i] == "y" and i > 0 and cons(s, i - 1))

    def m(s: str) -> int:
        shape = regex.sub(r"(.)\1*", r"\1", "".join("c" if cons(s, i) else "v" for i in range(len(s))))
        return shape.count("vc")

    def vowel(s: str) -> bool:
        return any(not cons(s, i) for i in range(len(s)))

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)

    def cvc(s: str) -> bool:
        return len(s) > 2 and cons(s, len(s) - 3) and not cons(s, len(s) - 2) and cons(s, len(s) - 1) and s[-1] not in "wxy"

    def swap(s: str, rules: tuple, least: int) -> str:
        for end, new in rules:
            if s.endswith(end):
                stem = s[: len(s) - len(end)]
                return stem + new if m(stem) > least and (end != "ion" or stem[-1:] in ("s", "t")) else s
        return s

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    w = swap(w, tuple((e, "") for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")), 1)
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if m(w) > 1 and double(w) and w.endswith("l") else w


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (one big integer a word)."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def rouge_l(reference: str | None, candidate: str | None) -> float:
    words_of = lambda s: [porter_stem(x) for x in regex.findall(r"[a-z0-9]+", (s or "").lower())]
    a, b = words_of(reference), words_of(candidate)
    n = _lcs(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


def with_rouge_l(df: DataFrame, reference: str, candidate: str, name: str = "rouge_l") -> DataFrame:
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, c in parts:
            yield pd.Series([rouge_l(x, y) for x, y in zip(r, c)], dtype=np.float64)

    return df.withColumn(name, run(reference, candidate))
