"""Mixing sources to target weights along a curriculum.

Every source i has a target share s_i and a weight schedule w_i(t) over the training time t in [0, 1], piecewise linear
between given points. The schedule says when the source comes, the share how much of it: with W_i the integral of w_i,
the cumulative token demand is D_i(t) = T * s_i * W_i(t) / W_i(1), piecewise quadratic. The documents of a source are
put in a pseudo-random order, each at its running token count c, and D_i is inverted at c in closed form: that t,
times T, is the training position. A range sort by position makes the mixed corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Blocks in which running token counts are summed, per source and epoch; raise it with the corpus.
BLOCKS = 1_024
#: Most rows of the target table: it is sent to every executor.
MAX_SOURCES = 10_000
#: Most points of all schedules together: they are sent to every executor, too.
MAX_POINTS = 100_000
#: Tilt of the sources that must be repeated, where no schedule is given: they come late; the others balance it.
LATE_TILT = 0.5


def normal_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""))


def integrate(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """The pieces (t, weight, slope, share before, share up to its end) of a schedule, whose whole integral is made 1.

    points: (t, weight), in any order; weights are linear in between and constant outside; several
    points with one t count as their mean. Without a positive weight the schedule is constant.
    """
    if any(not 0 <= t <= 1 or not 0 <= w < float("inf") for t, w in points):
        raise ValueError("schedules need times from 0 to 1 and finite weights of at least 0")
    at: dict[float, list[float]] = {}
    for t, w in points:
        at.setdefault(t, []).append(w)
    knots = [(t, sum(w) / len(w)) for t, w in sorted(at.items())] if any(w > 0 for _, w in points) else [(0.0, 1.0)]
    knots = [(0.0, knots[0][1]), *knots, (1.0, knots[-1][1])]
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, []
    if whole <= 0:
        return integrate([])
    for a, b, area in zip(knots, knots[1:], areas):
        if area > 0:
            upto = done + area / whole
            out.append((a[0], a[1] / whole, (b[1] - a[1]) / (b[0] - a[0]) / whole, done, upto))
            done = upto
    return out


def plan(sized: DataFrame, targets: DataFrame, schedules: DataFrame | None = None, total: int | None = None, late_tilt: float = LATE_TILT) -> list[dict]:
    """Per source of targets: size, share among the sources that have text, demand in tokens, epochs and schedule pieces.

    sized: (source, n_tokens) of the usable texts, of sources of targets. schedules: (source, t, weight), see
    integrate; rows with nulls are ignored. Where it is not given, sources that repeat get a weight that rises with
    time and the others one that balances it; given schedules leave sources without points a constant weight. The
    total is the largest for which no source needs more than max_repeats times its size, or the given one if that is
    smaller. Sources without text have demand 0. The result has a row per source (MAX_SOURCES at most), so it is made
    on the driver.
    """
    rows = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("size")).collect()}
    out = [{"source": r["source"], "target_share": float(r["target_share"]), "max_repeats": int(r["max_repeats"]), "size": int(sizes.get(r["source"]) or 0)} for r in rows]
    live = [x for x in out if x["size"] > 0 and x["target_share"] > 0 and x["max_repeats"] > 0]
    known = sum(x["target_share"] for x in live)
    most = min((x["size"] * x["max_repeats"] / (x["target_share"] / known) for x in live), default=0.0)
    goal = min(most, float(total)) if total is not None else most
    for x in out:
        x["share"] = x["target_share"] / known if x in live else 0.0
        x["demand"] = goal * x["share"]
        x["epochs"] = -int(-x["demand"] // x["size"]) if x["demand"] else 0
        x["late"] = x["epochs"] > 1
    late = sum(x["share"] for x in out if x["late"])
    tilt = min(late_tilt, (1 - late) / late) if 0 < late < 1 else 0.0
    points: dict[str, list[tuple[float, float]]] = {}
    if schedules is not None:
        given = schedules.select(normal_source(F.col("source")), F.col("t").cast("double"), F.col("weight").cast("double")).dropna().limit(MAX_POINTS + 1).collect()
        if len(given) > MAX_POINTS:
            raise ValueError(f"more than {MAX_POINTS} points of schedules")
        for source, t, weight in given:
            points.setdefault(source, []).append((t, weight))
    for x in out:
        if schedules is None:
            a = tilt if x["late"] else -tilt * late / (1 - late) if 0 < late < 1 else 0.0
            points[x["source"]] = [(0.0, 1 - a), (1.0, 1 + a)]
        x["pieces"] = integrate(points.get(x["source"], []))
    return out


def training_time(used: Column, pieces: Column) -> Column:
    """The time up to which a schedule (see integrate) has demanded the share ``used``, from 0 to 1, of its source's tokens."""
    last = F.element_at(pieces, -1)
    at = F.coalesce(F.get(F.filter(pieces, lambda p: (p["before"] <= used) & (used < p["upto"])), 0), last)

    def within(p: Column) -> Column:
        r = F.least(used, p["upto"]) - p["before"]
        root = F.sqrt(F.greatest(p["weight"] * p["weight"] + 2 * p["slope"] * r, F.lit(0.0)))
        return p["t"] + F.when(r > 0, 2 * r / (p["weight"] + root)).otherwise(0.0)

    return F.transform(F.array(at), within)[0]


def mix(docs: DataFrame, targets: DataFrame, schedules: DataFrame | None = None, total: int | None = None, blocks: int = BLOCKS, seed: int = 17) -> tuple[DataFrame, list[dict]]:
    """(doc_id, source, epoch, n_tokens, position), and the plan.

    docs: (doc_id, source, text_key, n_tokens), where text_key is equal exactly for equal texts. A text counts once
    however many documents have it: the one with the smallest doc_id stands for it, so no text is used more than
    max_repeats times. Sources without a row in targets and texts without tokens get nothing. A document is used in
    an epoch if its middle token lies within the demand of its source. schedules: see plan.
    """
    spark = docs.sparkSession
    named = docs.withColumn("source", normal_source(F.col("source"))).filter(F.col("n_tokens") > 0)
    wanted = targets.select(normal_source(F.col("source")).alias("source")).dropna().distinct().limit(MAX_SOURCES)
    named = named.join(F.broadcast(wanted), "source", "left_semi")
    texts = named.groupBy("text_key").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*")
    rows = plan(texts, targets, schedules, total)
    schema = "source string, size bigint, demand double, epochs int, pieces array<struct<t: double, weight: double, slope: double, before: double, upto: double>>"
    goals = spark.createDataFrame([(x["source"], x["size"], x["demand"], x["epochs"], x["pieces"]) for x in rows], schema)
    used = texts.join(F.broadcast(goals), "source").filter("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    order = F.xxhash64("doc_id", "epoch", F.lit(seed))
    used = used.withColumn("_order", order).withColumn("_block", F.floor((F.col("_order") / F.lit(2.0**64) + 0.5) * blocks).cast("int"))
    sums = used.groupBy("source", "epoch", "_block").agg(F.sum("n_tokens").alias("n"))
    before = W.Window.partitionBy("source", "epoch").orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select("source", "epoch", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = W.Window.partitionBy("source", "epoch", "_block").orderBy("_order", "doc_id").rowsBetween(W.Window.unboundedPreceding, 0)
    placed = used.withColumn("_upto", F.sum("n_tokens").over(inside)).join(offsets, ["source", "epoch", "_block"])
    middle = F.col("epoch") * F.col("size") + F.col("_offset") + F.col("_upto") - F.col("n_tokens") / 2
    goal = sum(x["demand"] for x in rows)
    placed = placed.withColumn("_c", middle).filter(F.col("_c") < F.col("demand"))
    position = training_time(F.col("_c") / F.col("demand"), F.col("pieces")) * F.lit(float(goal))
    mixed = placed.select("doc_id", "source", "epoch", "n_tokens", position.alias("position"))
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id"), rows


def shares(mixed: DataFrame, rows: list[dict]) -> DataFrame:
    """Reached shares: (source, target_share, actual_share, tokens, texts, most_uses) for every source of the plan."""
    spark = mixed.sparkSession
    goals = spark.createDataFrame([(x["source"], x["target_share"]) for x in rows], "source string, target_share double")
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    every = W.Window.partitionBy()  # one row per source
    out = goals.join(got, "source", "left").fillna(0, ["tokens", "texts", "most_uses"])
    whole = F.sum("tokens").over(every)
    return out.select("source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"), "tokens", "texts", "most_uses")
