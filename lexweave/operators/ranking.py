"""Ranking of anchor sections."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.graph import top_k

#: Heading words that earn the whole bonus, and half of it.
STRONG_HEADING = r"(?i)\b(definitions?|applicability)\b"
WEAK_HEADING = r"(?i)\b(purpose|scope|authority|compliance|reporting)\b"
#: Weights of the features.
WEIGHTS = {"terms": 0.45, "lexicon": 0.25, "references": 0.20, "in_degree": 0.05, "heading": 0.05}
#: What parts the words of a phrase.
BETWEEN = r"[\s\x{00A0}\-]+"
#: Most lexicon phrases of one pass over the texts.
MAX_PHRASES = 5_000


def minmax(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] within each group; a constant one becomes 0, nulls count as 0."""
    df = df.fillna(0, columns)
    ends = df.groupBy(*group).agg(*[f(c).alias(p + c) for c in columns for p, f in (("_lo_", F.min), ("_hi_", F.max))])
    j = df.join(ends, group)
    scaled = {c: F.when(F.col("_hi_" + c) - F.col("_lo_" + c) <= 1e-9 * F.greatest(F.abs("_hi_" + c), F.abs("_lo_" + c)), 0.0).otherwise((F.col(c) - F.col("_lo_" + c)) / (F.col("_hi_" + c) - F.col("_lo_" + c))) for c in columns}
    return j.withColumns(scaled).drop(*[p + c for c in columns for p in ("_lo_", "_hi_")])


def heading_bonus(c: Column) -> Column:
    h = F.coalesce(c, F.lit(""))
    return F.when(h.rlike(STRONG_HEADING), 1.0).when(h.rlike(WEAK_HEADING), 0.5).otherwise(0.0)


def _flat(c: Column) -> Column:
    """Lower case, words and signs parted by one blank, one at either end."""
    squeezed = F.regexp_replace(F.lower(c), BETWEEN, " ")
    return F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(squeezed, r"[^\p{L}\p{M}\p{N}_]", " $0 "), F.lit(" ")), " +", " ")


def _both(heading: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(heading, F.lit("")), F.coalesce(text, F.lit("")))


def _runs(words: Column, n: int) -> Column:
    every = F.transform(words, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, n)]))
    return F.slice(every, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def lexicon_hits(sections: DataFrame, keys: list[str], heading: str, text: str, lexicon: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(keys..., hits): the same as phrase_hits with a lexicon of any size, a table with one phrase per row.

    Runs of as many words as phrases have are joined with the phrases by equality; the number of different lengths is
    the only thing that goes to the driver.
    """
    known = lexicon.select(F.trim(_flat(F.col(phrase))).alias("_p")).filter("_p <> ''").groupBy("_p").agg(F.count("*").alias("_n"))
    lengths = sorted(r["n"] for r in known.select(F.size(F.split("_p", " ")).alias("n")).distinct().collect())
    words = sections.select(*keys, F.split(F.trim(_flat(_both(F.col(heading), F.col(text)))), " ").alias("_w"))
    runs = [_runs(F.col("_w"), n) for n in lengths]
    found = words.select(*keys, F.explode(F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")).alias("_p"))
    hits = found.join(known, "_p").groupBy(*keys).agg(F.sum("_n").alias("hits"))
    return sections.select(*keys).join(hits, keys, "left").select(*keys, F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))


def phrase_hits(heading: Column, text: Column, phrases: list[str]) -> Column:
    """How many phrases occur as whole words, blanks and hyphens alike, in any case; a phrase listed twice counts twice.

    phrases: a small lexicon, MAX_PHRASES at most, which is part of the expression; see lexicon_hits for larger ones.
    """
    phrases = [p.strip().lower() for p in phrases if p and p.strip()]
    if len(phrases) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases: use lexicon_hits")
    wanted = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("pattern")) for w, p in map(_sought, phrases)]).cast("array<struct<word: string, pattern: string>>")
    return F.element_at(F.transform(F.array(F.lower(_both(heading, text))), lambda h: F.size(F.filter(wanted, lambda p: h.contains(p["word"]) & F.rlike(h, p["pattern"])))), 1)


def _sought(phrase: str) -> tuple[str, str]:
    """The longest word of a phrase, and a pattern of the phrase; most texts lack the word, which is looked for first."""
    words = phrase.replace("-", " ").split() or [""]
    word = r"\p{L}\p{M}\p{N}_"
    if any(not (x == "_" or unicodedata.category(x)[0] in "LMN") for w in words for x in w) or words == [""]:
        return max(words, key=len), r"(?!)"  # signs are words of their own in texts, so no text has such a phrase
    return max(words, key=len), f"(?:^|[^{word}]){BETWEEN.join(words)}(?![{word}])"  # Java looks behind by one char, which misses letters of two


def waypoints(sections: DataFrame, features: dict[str, DataFrame | str], k: int = 12, window: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, sec_id, score, window, reason, rank): the k best sections of every document.

    features: by name a frame (doc_id, sec_id, value), or a column of the sections; sections that one lacks have 0 there.
    """
    weights = WEIGHTS | (weights or {})
    own = {name: f for name, f in features.items() if isinstance(f, str)}
    j = sections.select("doc_id", "sec_id", "idx", *[F.col(f).cast("double").alias(name) for name, f in own.items()])
    for name, f in features.items():
        if name not in own:
            j = j.join(f.select("doc_id", "sec_id", F.col("value").cast("double").alias(name)), ["doc_id", "sec_id"], "left")
    scaled = minmax(j, ["doc_id"], list(features))
    score = reduce(lambda a, b: a + b, [F.lit(weights[n]) * F.col(n) for n in features])
    out = scaled.select("doc_id", "sec_id", "idx", F.round(score, 6).alias("score"), F.lit(window).alias("window"), F.lit("terms+lexicon+references").alias("reason"))
    return top_k(out, ["doc_id"], [F.desc("score"), F.col("idx"), F.col("sec_id")], k).drop("idx")
