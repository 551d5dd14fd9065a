"""How distinctive a term is per record.

The score of a term in a record is its contribution to the relative entropy between the record's language model,
smoothed with a Dirichlet prior, and the model of the collection:

    p(t|d) = (tf + mu * p(t|C)) / (len(d) + mu),   score = p(t|d) * ln(p(t|d) / p(t|C))

Terms that are common everywhere get scores near 0, rare terms that a record repeats get large ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut

#: Dirichlet prior, in words.
MU = 1_000.0
#: Statistics of at most this many frequent terms are broadcast: a term is frequent from 1/FREQUENT of all postings.
FREQUENT = 5_000
#: Most collections of one call; their totals are sent to every executor.
MAX_COLLECTIONS = 10_000
#: Any maximal run of letters with marks; in Han, kana and Thai that is a clause.
WORD = r"[\p{L}\p{M}]+"
_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}\p{IsThai}"
#: Words of scripts that part them by blanks; runs of letters of Han, kana and Thai; one such letter with its marks.
SPACED = rf"[\p{{L}}&&[^{_SCRIPTS}]][\p{{L}}\p{{M}}&&[^{_SCRIPTS}]]*+"
RUN = rf"(?:[[{_SCRIPTS}]&&[\p{{L}}]]\p{{M}}*+)++"
UNIT = r"\p{L}\p{M}*+"
#: Six or more Latin letters (U+0041 to U+024F without the signs of multiplication and division).
LONG_LATIN = r"[A-Za-z\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]{6,}"


def runs_of(pattern: str = WORD) -> Callable[[Column], Column]:
    """The terms of a text are the matches of a pattern."""
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def all_words(text: Column) -> Column:
    """Terms in any script: words; of Han, kana and Thai, whose runs of letters are clauses, all pairs of neighbouring
    letters (with their marks), and letters that stand alone."""

    def pairs(run: Column) -> Column:
        units = F.array(F.regexp_extract_all(run, F.lit(UNIT), F.lit(0)))  # in an array of one, to be made once
        both = F.transform(units, lambda u: F.when(F.size(u) < 2, u).otherwise(F.slice(F.transform(u, lambda x, i: F.concat_ws("", x, F.get(u, i + 1))), 1, F.size(u) - 1)))
        return F.element_at(both, 1)

    unspaced = F.when(text.rlike(RUN), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), pairs)))
    return F.concat(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)), F.coalesce(unspaced, F.array().cast("array<string>")))


def term_counts(df: DataFrame, keys: list[str], text: str, terms: Callable[[Column], Column] = runs_of()) -> DataFrame:
    """(keys..., term, tf, len): how often each term occurs in each record, and how many terms that has.

    terms: gives the terms of a text (see runs_of, all_words). Null and empty texts give no rows. Keys should be
    unique; where they are not, tf is summed over the rows and len is that of the longest. Counting starts in the
    scan's tasks, where all of a record's terms are.
    """
    found = F.transform(terms(F.col(text)), lambda t: F.lower(t))
    listed = df.select(*keys, found.alias("_terms")).select(*keys, F.size("_terms").alias("len"), F.explode("_terms").alias("term"))
    return listed.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def distinctive_terms(
    df: DataFrame, collection: list[str], record: list[str], text: str, terms: Callable[[Column], Column] = runs_of(), mu: float = MU, min_df: int = 1, frequent: int = FREQUENT
) -> DataFrame:
    """(collection..., record..., term, tf, df, len, score) for every term of every record.

    collection: columns that name the collection a record is compared with (a table here). min_df: terms in fewer
    records get no row. A record is identified by collection and record together; two rows with the same
    identification count as one record. Terms are counted once, into a checkpoint that statistics and scores read.
    Statistics of frequent terms are broadcast, their number being bounded by ``frequent`` per collection; all others
    are joined by a shuffle in which no term is large. The totals have a row per collection, at most MAX_COLLECTIONS.
    """
    keys = [*collection, *record]
    counts = cut(term_counts(df, keys, text, terms))
    stats = counts.groupBy(*collection, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = cut(stats)
    totals = stats.groupBy(*collection).agg(F.sum("cf").alias("words"), F.sum("df").alias("postings"))
    few = totals.limit(MAX_COLLECTIONS + 1).collect()
    if len(few) > MAX_COLLECTIONS:
        raise ValueError(f"more than {MAX_COLLECTIONS} collections")
    totals = df.sparkSession.createDataFrame(few, totals.schema)
    known = stats.join(F.broadcast(totals), collection)
    is_frequent = F.col("df") * frequent >= F.greatest(F.col("postings"), F.lit(frequent))
    common, rare = known.filter(is_frequent), known.filter(~is_frequent)
    on = [*collection, "term"]
    usual = counts.join(F.broadcast(common), on)
    other = counts.join(F.broadcast(common.select(*on)), on, "left_anti").join(rare, on)
    p_c = F.col("cf") / F.col("words")
    p_d = (F.col("tf") + F.lit(mu) * p_c) / (F.col("len") + F.lit(mu))
    return usual.unionByName(other).filter(F.col("df") >= min_df).select(*keys, "term", "tf", "df", "len", (p_d * F.log(p_d / p_c)).alias("score"))
