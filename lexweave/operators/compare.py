"""Comparison of two versions of the same sections."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators.graph import top_k


def unigrams(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_§.]+", " "))
    return F.filter(F.split(s, " "), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones, 0 for one empty one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance. What both begin and end with is left out; of the rest, whole columns of the table are one
    integer's bits (Myers), so a row costs a few operations on len(a) bits."""
    start = 0
    for x, y in zip(a, b):
        if x != y:
            break
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = every, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (every & ~(horizontal | plus)), plus & horizontal
        distance += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        plus, minus = (down | ~(vertical | up)) & every, up & vertical & every
    return distance


def _similarities(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else 100.0 * (1 - edit_distance(x, y) / max(len(x), len(y))) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / longer length); 100 for equal texts, two empty ones included; null if one is null."""
    run = F.pandas_udf(_similarities, "double")
    return F.when(a == b, 100.0).otherwise(run(F.when(a != b, a), F.when(a != b, b)))


def compare_sections(left: DataFrame, right: DataFrame) -> DataFrame:
    """The parity report of sections that both sides have: (doc_id, sec_id, heading, text) each, one row per section.

    Text comparison is quadratic in the text's length, exact, inside one row.
    """
    blank = lambda c: t.squeeze_blanks(F.coalesce(c, F.lit("")))
    a = left.select("doc_id", "sec_id", blank(F.col("text")).alias("x"), F.col("heading").alias("xml_heading"))
    b = right.select("doc_id", "sec_id", blank(F.col("text")).alias("y"), F.col("heading").alias("pdf_heading"))
    j = a.join(b, ["doc_id", "sec_id"])
    nx, ny = F.length("x"), F.length("y")
    return j.select(
        "doc_id", "sec_id", nx.alias("xml_len"), ny.alias("pdf_len"), F.round(ny / F.greatest(F.lit(1), nx), 3).alias("len_ratio"),
        t.token_count(F.col("x")).alias("xml_tokens"), t.token_count(F.col("y")).alias("pdf_tokens"),
        F.round(jaccard(F.array_distinct(unigrams(F.col("x"))), F.array_distinct(unigrams(F.col("y")))), 3).alias("jaccard_unigram"),
        F.round(similarity(F.col("x"), F.col("y")), 1).alias("rf_similarity"), "xml_heading", "pdf_heading",
    )


def worst(report: DataFrame, n: int = 15) -> DataFrame:
    """Per document the n least similar sections."""
    order = [F.col("rf_similarity").asc_nulls_last(), F.abs(1 - F.col("len_ratio")).desc_nulls_last(), F.col("sec_id")]
    return top_k(report, ["doc_id"], order, n)


def missing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, sec_id, side): sections that only one side has."""
    a, b = (x.select("doc_id", "sec_id").distinct() for x in (left, right))
    only = lambda x, y, s: x.join(y, ["doc_id", "sec_id"], "left_anti").withColumn("side", F.lit(s))
    return only(a, b, "left_only").unionByName(only(b, a, "right_only"))


def unified_diffs(df: DataFrame, left: str, right: str, name: str = "diff") -> DataFrame:
    """df with the unified diff of two text columns, line by line."""

    @F.pandas_udf("string")
    def diff(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "left", "right", lineterm="")) for x, y in zip(a, b)])

    return df.withColumn(name, diff(left, right))
