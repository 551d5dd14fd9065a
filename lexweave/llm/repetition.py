"""Repetition inside a single document.

Statistics of repetition are plain Catalyst expressions over one row. A decision list, learned by sequential
covering from labelled rows (grow a conjunction of thresholds by information gain, prune it on held-out rows, remove
what it covers, go on), is emitted as an ordered Spark conditional expression over cheap statistics and picks the
repetitive texts; the exact share of repeated runs, which is no statistic of the list, is measured of these only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of scripts whose words are not parted by blanks.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
#: Most labelled rows that a decision list is fitted on.
MAX_LABELLED = 20_000
#: A labelled row counts as repetitive for the fit from this reported share; it lies below the share that is asked
#: for, so that the list keeps doubtful texts for the exact measure.
FIT_SHARE = 0.15


def _runs(items: Column, n: int, sep: str) -> Column:
    """All runs of n neighbouring items (a column, no expression), joined by sep; none if there are fewer items."""
    every = F.transform(items, lambda x, i: F.concat_ws(sep, x, *[F.get(items, i + k) for k in range(1, n)]))
    return F.slice(every, 1, F.greatest(F.size(items) - (n - 1), F.lit(0)))


def _pairs(items: Column, n: int) -> Column:
    """The hashes of all runs of n neighbouring items."""
    every = F.transform(items, lambda x, i: F.xxhash64(x, *[F.get(items, i + k) for k in range(1, n)]))
    return F.slice(every, 1, F.greatest(F.size(items) - (n - 1), F.lit(0)))


def _share(runs: Column) -> Column:
    """Share of the runs that already occurred before; made with one evaluation of runs."""
    one = F.transform(F.array(runs), lambda r: F.when(F.size(r) > 0, 1 - F.size(F.array_distinct(r)) / F.size(r)).otherwise(F.lit(0.0)))
    return F.element_at(one, 1)


#: White space of every kind.
BLANK = r"\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def words(text: Column) -> Column:
    """Lower-case words, parted by white space; within them all that is no letter or mark is deleted."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{M}}{BLANK}]+", ""), rf"[{BLANK}]+"), lambda w: w != "")


def letters(text: Column) -> Column:
    """Lower-case letters, with marks, as an array."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", ""), ""), lambda w: w != "")


def _sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(text), r"[0-9]+", ""), r"(?<=[.!?؟।])\s+|(?<=[。！？])|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


#: Statistics that a decision list may test, the most telling ones first.
STATISTICS = ["pair_share", "unit_share", "sentence_share", "n_units"]
#: Share of labels that may be wrong, and fewest class members that a rule must cover.
LABEL_NOISE, LEAST_COVER = 0.15, 3
#: A reported share that is farther from the measured one is stale, and no label.
STALE = 0.05


def with_units(df: DataFrame, text: str) -> DataFrame:
    """df with ``_p``: whether the text has letters of unspaced scripts (u), and its words or letters (w).

    It leaves through a generator of one row: the optimizer does not copy expressions across it, so units are cut once
    a row however often statistics, rules and filters name them. A null text counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    unspaced = t.rlike(UNSPACED)
    return df.drop("_p").select("*", F.explode(F.array(F.struct(unspaced.alias("u"), F.when(unspaced, letters(t)).otherwise(words(t)).alias("w")))).alias("_p"))


def repeated_share(units: DataFrame) -> DataFrame:
    """units (see with_units) with ``repeated_share``, exactly: the share of runs of three words (eight letters in
    texts with Han, kana or Thai letters) that already occurred in the text; 0 if there is no run."""
    u, w = F.col("_p")["u"], F.col("_p")["w"]
    return units.drop("repeated_share").select("*", F.explode(F.array(F.when(u, _share(_runs(w, 8, ""))).otherwise(_share(_runs(w, 3, " "))))).alias("repeated_share"))


def with_shares(df: DataFrame, text: str) -> DataFrame:
    """df with the exact repeated_share of every text; a column of this name is replaced."""
    return repeated_share(with_units(df, text)).drop("_p")


def with_statistics(units: DataFrame, text: str) -> DataFrame:
    """units (see with_units) with the columns of STATISTICS, which need no run of full length and no joined strings.

    pair_share: share of pairs of words (runs of four letters) that occurred before, never less than the share of
    longer runs but for one run; unit_share: of words (pairs of letters); sentence_share: of sentences. Columns of
    these names are replaced.
    """
    u, w = F.col("_p")["u"], F.col("_p")["w"]
    statistics = F.struct(
        _share(F.when(u, _pairs(w, 4)).otherwise(_pairs(w, 2))).alias("pair_share"),
        _share(F.when(u, _pairs(w, 2)).otherwise(_pairs(w, 1))).alias("unit_share"),
        _share(_sentences(F.coalesce(F.col(text), F.lit("")))).alias("sentence_share"),
        F.size(w).cast("double").alias("n_units"),
    )
    return units.drop(*STATISTICS, "_s").select("*", F.explode(F.array(statistics)).alias("_s")).select("*", "_s.*").drop("_s")


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] >= self.threshold if self.at_least else x[self.statistic] < self.threshold

    def column(self) -> Column:
        return F.col(self.statistic) >= self.threshold if self.at_least else F.col(self.statistic) < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row belongs to the class if a rule holds."""

    rules: tuple[tuple[Condition, ...], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), dtype=bool)
        for rule in self.rules:
            out |= _covered(rule, x)
        return out

    def column(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for c in rule:
                test = test & c.column()
            out = F.when(test, i) if out is None else out.when(test, i)
        return F.lit(0) if out is None else out.otherwise(0)

    def __str__(self) -> str:
        return "\n".join("IF " + " AND ".join(f"{c.statistic} {'>=' if c.at_least else '<'} {c.threshold:.4g}" for c in r) for r in self.rules)


def _covered(rule: tuple[Condition, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    m = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        m &= c.mask(x)
    return m


def _best_threshold(name: str, v: np.ndarray, y: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of one statistic with the largest information gain, over all thresholds at once.

    A threshold lies just above the lower of two neighbouring values, so the gap between them goes to the class above.
    """
    order = np.argsort(v, kind="stable")
    v, y = v[order], y[order]
    at = np.flatnonzero(v[1:] > v[:-1])
    if not len(at):
        return 0.0, None
    p0, n0 = int(y.sum()), int((~y).sum())
    below_p, below = np.cumsum(y)[at], at + 1
    base = math.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (1e-9, None)
    for up in (True, False):
        p = p0 - below_p if up else below_p
        n = len(y) - below if up else below
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(p > 0, p * (np.log2(p / n) - base), -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = float(gain[i]), Condition(name, up, float(np.nextafter(v[at[i]], np.inf)))
    return best


def _grow(x: dict[str, np.ndarray], y: np.ndarray, noise: float) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    m = np.ones(len(y), dtype=bool)
    while (~y[m]).mean() > noise and len(rule) < 4:
        found = [_best_threshold(n, v[m], y[m]) for n, v in x.items()]
        most = max(g for g, _ in found)
        best = next(c for g, c in found if g >= most * (1 - noise))  # of statistics as good but for noise, the first
        if best is None:
            break
        rule += (best,)
        m &= best.mask(x)
    return rule


def _prune(rule: tuple[Condition, ...], x: dict[str, np.ndarray], y: np.ndarray, noise: float) -> tuple[Condition, ...]:
    """The shortest beginning of the rule that is as good on held-out rows as the best one, but for label noise."""

    def worth(r: tuple[Condition, ...]) -> float:
        k = _covered(r, x)
        p, n = int((k & y).sum()), int((k & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    options = [rule[:i] for i in range(1, len(rule) + 1)]
    best = max(map(worth, options), default=0.0)
    return next((r for r in options if worth(r) >= best - noise), rule)


def _loosen(rule: tuple[Condition, ...], x: dict[str, np.ndarray], y: np.ndarray, noise: float) -> tuple[Condition, ...]:
    """The rule with every lower limit moved down as far as the others of its class are at most the noise among what it covers.

    A single wrong label inside the class's range so moves no limit, while the limit stops where the other class begins.
    """
    out = list(rule)
    for i, c in enumerate(rule):
        if not c.at_least:
            continue
        m = _covered(tuple(out[:i] + out[i + 1 :]), x)
        v, k = x[c.statistic][m], y[m]
        order = np.argsort(-v, kind="stable")
        v, wrong = v[order], np.cumsum(~k[order])
        ok = np.flatnonzero((wrong <= noise * np.arange(1, len(v) + 1)) & (np.append(v[1:], -np.inf) < v) & (v > 0))
        if len(ok):
            below = v[ok[-1] + 1] if ok[-1] + 1 < len(v) else 0.0
            lowest = float(np.nextafter(below, np.inf))  # the gap to the next value belongs to the class
            if lowest < c.threshold:
                out[i] = Condition(c.statistic, True, lowest)
    return tuple(out)


def learn_decision_list(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7, noise: float = LABEL_NOISE, least_cover: int = LEAST_COVER) -> DecisionList:
    """Sequential covering: rules are grown on two thirds of the rows that are left and pruned on the others.

    It ends when no class member is left, or a new rule covers fewer than least_cover of them or more of the others.
    """
    rng = np.random.default_rng(seed)
    rules: list[tuple[Condition, ...]] = []
    left = np.arange(len(y))
    while y[left].any() and len(rules) < 12:
        shuffled = rng.permutation(left)
        grow, prune = shuffled[: max(1, 2 * len(left) // 3)], shuffled[2 * len(left) // 3 :]
        if not y[grow].any():
            grow = prune = left
        rule = _grow({k: v[grow] for k, v in x.items()}, y[grow], noise)
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, y[prune], noise)
        rule = _loosen(rule, {n: v[left] for n, v in x.items()}, y[left], noise)
        k = _covered(rule, {n: v[left] for n, v in x.items()})
        if not rule or y[left][k].sum() < max(least_cover, (~y[left][k]).sum()):
            break
        rules.append(rule)
        left = left[~k]
    return DecisionList(tuple(rules))


def reported_share(c: Column) -> Column:
    """A reported redundancy as a share: values above 1 are percentages; null stays null."""
    return F.when(~F.isnan(c), F.when(c > 1, c / 100).otherwise(c))


def fit_repetition(labelled: DataFrame, text: str, reported: str, fit_share: float = FIT_SHARE, max_rows: int = MAX_LABELLED) -> DecisionList:
    """A decision list fitted on at most max_rows labelled rows (those of the lowest text hash).

    The label is whether the reported share is at least fit_share; reports that are farther than STALE from the
    measured share are stale and left out. Pruning and the precision limit keep single wrong labels from making rules.
    Without a usable label the list has the single rule ``pair_share >= fit_share``.
    """
    share = reported_share(F.col(reported).cast("double"))
    rows = labelled.select(F.col(text).alias("_t"), share.alias("_y")).filter("_y IS NOT NULL AND _t IS NOT NULL").orderBy(F.xxhash64("_t"), "_t", "_y").limit(max_rows)
    rows = with_statistics(repeated_share(with_units(rows, "_t")), "_t").filter(F.abs(F.col("_y") - F.col("repeated_share")) <= STALE)
    rows = rows.select("_y", *STATISTICS).toPandas()
    y = (rows["_y"] >= fit_share).to_numpy(dtype=bool)
    if y.any() and not y.all():
        found = learn_decision_list({n: rows[n].to_numpy(dtype=float) for n in STATISTICS}, y)
        if found.rules:
            return found
    return DecisionList(((Condition("pair_share", True, fit_share),),))


def flagged_texts(df: DataFrame, text: str, rules: DecisionList) -> DataFrame:
    """The rows of df that the list flags, with their statistics and ``rule``, the number of the first rule that holds."""
    return with_statistics(with_units(df, text), text).withColumn("rule", rules.column()).filter(F.col("rule") > 0)


def repetitive_texts(df: DataFrame, text: str, rules: DecisionList, least_share: float = 0.25) -> DataFrame:
    """The rows that the list flags, and of them those whose exact repeated_share is at least least_share.

    Only flagged rows are measured exactly. A null or empty text has no repetition; columns that clash with the
    statistics, rule or repeated_share are replaced; rows that repeat are judged each.
    """
    return repeated_share(flagged_texts(df, text, rules)).filter(F.col("repeated_share") >= least_share).drop("_p")
