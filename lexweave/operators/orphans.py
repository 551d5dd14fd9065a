"""References to records that do not exist, were gone, or had not yet come when the reference was seen.

References are counted per key and period first, and so are the starts of presence intervals. A key's interval starts,
taken period by period, tell up to when earlier starts reach (``carry``). That settles most periods as a whole: all
present if the carry reaches beyond the last reference, all orphan if it ends before the first one and nothing starts
in the period. Only the references of open periods are looked at one by one, against the intervals that start in the
same period. Keys that hold a large part of the references (their number is bounded by the share that makes a key
heavy) are checked map-side against a broadcast; all other keys go through a shuffled anti-join, where by definition
no key is large. Both orphan sets, or their counts, are united. No reference is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexweave.functions.keys import cited_title, section_id
from lexweave.session import cut

#: A key is heavy from 1/HEAVY_SHARE of all references; so at most HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 2_000
#: Most periods and presence intervals of heavy keys that are broadcast; beyond it those keys take the shuffled way, salted.
BROADCAST_INTERVALS = 200_000
SALTS = 32
FOREVER = "9999-12-31 00:00:00"


def presence_intervals(df: DataFrame, key: Column, start: str, end: str) -> DataFrame:
    """(target, from_ts, until_ts): one row per target and start; an open end is far in the future.

    Rows without a start never were present.
    """
    return (
        df.select(key.alias("target"), F.col(start).alias("from_ts"), F.coalesce(F.col(end), F.lit(FOREVER).cast("timestamp")).alias("until_ts"))
        .filter("target IS NOT NULL AND from_ts IS NOT NULL AND until_ts > from_ts")
        .groupBy("target", "from_ts")
        .agg(F.max("until_ts").alias("until_ts"))
    )


def _month(c: str) -> Column:
    return F.trunc(c, "month").alias("period")


def _usable(refs: DataFrame) -> DataFrame:
    return refs.filter("target IS NOT NULL AND seen_at IS NOT NULL")


def unsettled_periods(refs: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """(target, period, by..., n, carry, settled): the periods of a key whose references are not all present.

    n references of one key, period and value of by; carry: up to when intervals reach that start in earlier periods;
    settled: all n are orphans, nothing starts in the period.
    """
    seen = _usable(refs).groupBy("target", _month("seen_at"), *by).agg(F.count("*").alias("n"), F.min("seen_at").alias("lo"), F.max("seen_at").alias("hi"))
    starts = intervals.groupBy("target", _month("from_ts")).agg(F.max("until_ts").alias("reach"))
    both = seen.withColumn("reach", F.lit(None).cast("timestamp")).unionByName(starts, allowMissingColumns=True)
    # A key has a few rows per month here, however many references or intervals it has.
    earlier = W.Window.partitionBy("target").orderBy(F.col("period").cast("timestamp").cast("long")).rangeBetween(W.Window.unboundedPreceding, -1)
    here = W.Window.partitionBy("target", "period")
    known = both.withColumns({"carry": F.max("reach").over(earlier), "begins": F.max("reach").over(here).isNotNull()}).filter("n IS NOT NULL")
    missing = known.filter("carry IS NULL OR carry <= hi")
    return missing.select("target", "period", *by, "n", "carry", (~F.col("begins") & (F.col("carry").isNull() | (F.col("carry") <= F.col("lo")))).alias("settled"))


def _missing(refs: DataFrame, periods: DataFrame, intervals: DataFrame, small: bool, salts: int = 1) -> DataFrame:
    """The rows of refs that neither the carry of their period nor an interval that starts in it covers.

    small: periods and intervals fit a broadcast. salts: parts of one key otherwise.
    """
    keys, columns = ["target", "period"], refs.columns
    refs, intervals = refs.withColumn("period", _month("seen_at")), intervals.withColumn("period", _month("from_ts"))
    if salts > 1:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        refs = refs.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)))
        periods, intervals = periods.withColumn("_salt", every), intervals.withColumn("_salt", every)
        keys.append("_salt")
    how = F.broadcast if small else lambda df: df.hint("merge")
    due = refs.join(how(periods.select(*keys, "carry")), keys).filter("carry IS NULL OR carry <= seen_at")
    covers = (F.col("i.from_ts") <= F.col("r.seen_at")) & (F.col("i.until_ts") > F.col("r.seen_at"))
    for k in keys:
        covers = covers & (F.col(f"r.{k}") == F.col(f"i.{k}"))
    return due.alias("r").join(how(intervals).alias("i"), covers, "left_anti").select(*columns)


def _checked(refs: DataFrame, periods: DataFrame, intervals: DataFrame, heavy_share: int, broadcast_intervals: int) -> DataFrame:
    """The orphans among the references of the given (target, period, carry), heavy keys apart."""
    spark = refs.sparkSession
    refs = _usable(refs)
    least = max(refs.count(), heavy_share)
    counted = refs.groupBy("target").count().filter(F.col("count") * heavy_share >= least)
    heavy = spark.createDataFrame(counted.select("target").limit(heavy_share).collect(), refs.select("target").schema)  # heavy_share rows at most
    apart = lambda df, how: df.join(F.broadcast(heavy), "target", how)
    light = _missing(apart(refs, "left_anti"), apart(periods, "left_anti"), apart(intervals, "left_anti"), small=False)
    heavy_periods, heavy_intervals = apart(periods, "left_semi"), apart(intervals, "left_semi")
    sizes = heavy_periods.select("target").unionAll(heavy_intervals.select("target"))
    small = sizes.limit(broadcast_intervals + 1).count() <= broadcast_intervals
    return light.unionByName(_missing(apart(refs, "left_semi"), heavy_periods, heavy_intervals, small, 1 if small else SALTS))


def orphans(refs: DataFrame, intervals: DataFrame, heavy_share: int = HEAVY_SHARE, broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """The rows of refs (with columns target and seen_at) whose target is not present at seen_at.

    A target is present at t if one of its intervals has from_ts <= t < until_ts. Rows whose target or seen_at is
    null are no orphans: nothing can be said about them. refs and intervals are read several times: cut them where they
    are dear. Columns period, _salt and carry of refs must not be asked for: they are replaced.
    """
    periods = cut(unsettled_periods(refs, intervals, []))
    return _checked(refs, periods, intervals, heavy_share, broadcast_intervals)


def orphan_counts(refs: DataFrame, intervals: DataFrame, by: list[str], heavy_share: int = HEAVY_SHARE, broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """(by..., month, orphans, targets): orphan references and distinct targets per value of by and month of seen_at.

    Settled periods bring their count; of open ones the references are checked and counted; both are united.
    """
    periods = cut(unsettled_periods(refs, intervals, by))
    sure = periods.filter("settled").select(*by, "target", "period", "n")
    open_periods = periods.filter("NOT settled").groupBy("target", "period").agg(F.max("carry").alias("carry"))
    open_refs = refs.select("target", "seen_at", *by)
    found = _checked(open_refs, open_periods, intervals, heavy_share, broadcast_intervals)
    # by values of one key and period are settled or open each; those settled are counted already
    found = found.groupBy(*by, "target", _month("seen_at")).agg(F.count("*").alias("n"))
    found = found.join(sure, [*by, "target", "period"], "left_anti")
    every = sure.unionByName(found)
    return every.groupBy(*by, F.date_format("period", "yyyy-MM").alias("month")).agg(F.sum("n").alias("orphans"), F.count("*").alias("targets"))


def citation_targets(sections: DataFrame, cited_titles: DataFrame) -> DataFrame:
    """Presence intervals of everything a citation may name."""
    own = F.concat(F.lit("sections|"), "doc_id", F.lit("|"), section_id(F.col("sec_id")))
    other = F.concat(F.lit("cited_titles|"), F.coalesce(cited_title(F.col("token")), F.col("token")))
    return presence_intervals(sections, own, "loaded_at", "removed_at").unionByName(presence_intervals(cited_titles, other, "listed_from", "listed_until"))


def citation_references(flat: DataFrame) -> DataFrame:
    """(ref_id, field_name, target_table, target, seen_at): both ends of every citation; unreadable ones have a null target."""
    cross = F.coalesce(F.col("match_kind") == "crossdoc", F.lit(False))
    read = F.struct(
        section_id(F.col("src_sec_id")).alias("src"),
        F.when(cross, cited_title(F.col("norm_token"))).otherwise(section_id(F.col("norm_token"))).alias("token"),
        F.when(cross, "cited_titles").otherwise("sections").alias("tbl"),
    )
    # through a generator of one row, which the optimizer does not copy expressions across: ids are read once
    flat = flat.select("ref_id", "seen_at", "doc_id", F.explode(F.array(read)).alias("k"))
    ends = F.array(
        F.struct(F.lit("src_sec_id").alias("field_name"), F.lit("sections").alias("target_table"), F.col("k.src").alias("key")),
        F.struct(F.lit("norm_token").alias("field_name"), F.col("k.tbl").alias("target_table"), F.col("k.token").alias("key")),
    )
    each = flat.select("ref_id", "seen_at", "doc_id", F.explode(ends).alias("e")).select("ref_id", "seen_at", "doc_id", "e.*")
    target = F.when(F.col("target_table") == "cited_titles", F.concat(F.lit("cited_titles|"), "key")).otherwise(F.concat(F.lit("sections|"), "doc_id", F.lit("|"), "key"))
    return each.select("ref_id", "field_name", "target_table", target.alias("target"), "seen_at")


def orphan_citations(flat: DataFrame, sections: DataFrame, cited_titles: DataFrame, **options: int) -> DataFrame:
    """Every orphan end of a citation: (ref_id, field_name, target_table, target, seen_at)."""
    return orphans(cut(_usable(citation_references(flat))), cut(citation_targets(sections, cited_titles)), **options)


def orphan_citation_counts(flat: DataFrame, sections: DataFrame, cited_titles: DataFrame, **options: int) -> DataFrame:
    """Orphan ends of citations per field, target table and month of seen_at."""
    refs = cut(_usable(citation_references(flat)).select("field_name", "target_table", "target", "seen_at"))
    return orphan_counts(refs, cut(citation_targets(sections, cited_titles)), ["field_name", "target_table"], **options)
