"""Consolidating pairwise matches into groups.

Union-find runs inside edge partitions and keeps only a spanning forest of each (every record once, under the root of
its set). Forests are then merged through bounded partitions: their edges are measured, a scope that fits one
partition is merged there at once, and one that does not is spread over as many partitions as it needs. What such a
level leaves is a smaller graph: its records are the roots, and two roots are linked if some record has both. That
graph is measured and merged in the same way, level by level, until every scope fits one partition; then each record
follows its root up the levels to its global component. A scope is a key that links never cross (a regulation here;
none makes the whole table one scope).

Scale. No partition holds more than about ``limit`` edges at any level, whatever the size of a scope. A level's edges
are spread by the end of larger priority, so that all smaller neighbours of a record meet and only a constant share of
records can stay roots (priorities are hashes, drawn anew at every level, so that no order of ids is unfortunate);
records with very many links are salted. On a path, the worst case, half of the records stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut

#: Most edges that one union-find holds at once (about 300 bytes each while it works).
LIMIT = 1_000_000
#: Most rows of a finished level that are broadcast to the level below it.
MAX_BROADCAST = 200_000
#: Levels after which something must be wrong: each shrinks the graph by a constant share.
MAX_LEVELS = 100
STAR = "scope string, record string, root string, least string"


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The root of each of n elements after the unions of a[i] and b[i]; a root is the smallest element of its set.

    All open unions are made at once (the larger root goes under the smallest root that it meets), then all paths are
    compressed.
    """
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        a, b = np.minimum(x, y), np.maximum(x, y)
        still = a != b
        if not still.any():
            return root
        a, b = a[still], b[still]
        np.minimum.at(root, b, a)
        while (root != (up := root[root])).any():
            root = up


def _codes(*parts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The values of all parts as numbers in the order of their bytes, which is code point order, and the ordered values."""
    chunks = [c for p in parts for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])]
    coded = pa.concat_arrays(chunks).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def star_forest(edges: pa.Table) -> pa.RecordBatch:
    """(scope, record, root, least) of every record of edges (scope, a, b, ha, hb and perhaps la, lb).

    root: the record of the set with the smallest priority h; least: the smallest record known to be in the set.
    """
    a, b = edges["a"], edges["b"]
    scope, scopes = _codes(edges["scope"])
    record, records = _codes(a, b)
    key, first, at = np.unique(np.concatenate([scope, scope]) * len(records) + record, return_index=True, return_inverse=True)
    n, m = len(key), len(scope)
    if "la" in edges.column_names:
        low, lows = _codes(edges["la"], edges["lb"])
    else:
        low, lows = record, records
    priority = np.concatenate([edges["ha"].to_numpy(), edges["hb"].to_numpy()])[first]
    order = np.lexsort((key, priority))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    root = order[union_find(place[at[:m]], place[at[m:]], n)[place]]
    least = np.full(n, len(lows), dtype=np.int64)
    np.minimum.at(least, root[at], low)
    name = records.take(pa.array(key % len(records)))
    columns = [scopes.take(pa.array(key // len(records))), name, name.take(pa.array(root)), lows.take(pa.array(least[root]))]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns], names=["scope", "record", "root", "least"])


def _forests(limit: int, grouped: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Forests of a partition, limit edges at a time; grouped: the rows of one (scope, part), which follow each other, stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < limit:
                continue
            table = pa.Table.from_batches(held)
            done = table.num_rows
            if grouped:
                last = table.slice(done - 1)
                same = pc.and_(pc.equal(table["scope"], last["scope"][0]), pc.equal(table["part"], last["part"][0]))
                done -= int(pc.sum(same).as_py())
            if done:
                yield star_forest(table.slice(0, done))
            held = table.slice(done).to_batches()
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield star_forest(table)

    return run


def _prioritized(edges: DataFrame, level: int) -> DataFrame:
    return edges.withColumns({"ha": F.xxhash64("a", F.lit(level)), "hb": F.xxhash64("b", F.lit(level))})


def _spread(edges: DataFrame, large: DataFrame, limit: int) -> DataFrame:
    """edges with ``part``: 0 where the scope fits one partition, else by the end of larger priority; records with very many links get several parts.

    large: (scope, parts), at most one row per limit edges; so many records at most have more than limit / 2 links.
    """
    first = (F.col("ha") < F.col("hb")) | ((F.col("ha") == F.col("hb")) & (F.col("a") < F.col("b")))
    e = edges.join(F.broadcast(large), "scope", "left").withColumns({"upper": F.when(first, F.col("b")).otherwise(F.col("a")), "lower": F.when(first, F.col("a")).otherwise(F.col("b"))})
    links = e.filter("parts IS NOT NULL").groupBy("scope", "upper").count().filter(F.col("count") > limit // 2)
    hot = links.select("scope", "upper", F.ceil(F.col("count") / (limit // 2)).alias("salts"))
    e = e.join(F.broadcast(hot), ["scope", "upper"], "left")
    salt = F.coalesce(F.pmod(F.xxhash64("lower"), F.col("salts")), F.lit(0))
    part = F.coalesce(F.pmod(F.xxhash64("upper", salt), F.col("parts")), F.lit(0))
    return e.withColumn("part", part).drop("parts", "salts", "upper", "lower")


def _merged(edges: DataFrame, limit: int) -> DataFrame:
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(tasks, "scope", "part").sortWithinPartitions("scope", "part").mapInArrow(_forests(limit, grouped=True), STAR)


def _follow(level: DataFrame, above: DataFrame, limit: int) -> DataFrame:
    """(scope, record, least): every record of a level with what the level above says of its root, if it is there.

    A root may have very many records: such roots (limit or more; few, therefore) are looked up by broadcast.
    """
    above = above.select("scope", F.col("record").alias("root"), F.col("least").alias("_least"))
    keys = ["scope", "root"]
    small = above.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    if small:
        found = level.join(F.broadcast(above), keys, "left")
    else:
        heavy = level.groupBy(*keys).count().filter(F.col("count") >= limit).select(*keys)
        found = level.join(F.broadcast(heavy), keys, "left_anti").join(above, keys, "left")
        found = found.unionByName(level.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(above.join(F.broadcast(heavy), keys, "left_semi")), keys, "left"))
    return found.select("scope", "record", F.coalesce("_least", "least").alias("least"))


def connected_components(edges: DataFrame, scope: str | None, a: str, b: str, limit: int = LIMIT) -> DataFrame:
    """(scope, record, group_id): every record of an edge, with the smallest record linked to it directly or not.

    Rows with a null scope or a null end are ignored; a record linked only to itself is its own group; repeated rows
    change nothing; an empty table gives none. Records are compared in code point order. limit changes no result.
    """
    key: Column = F.col(scope).cast("string") if scope else F.lit("")
    pairs = edges.select(key.alias("scope"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    forests = _prioritized(pairs, 0).mapInArrow(_forests(limit, grouped=False), STAR)
    now = cut(forests.select("scope", F.col("record").alias("a"), F.col("root").alias("b")))
    levels: list[DataFrame] = []
    while len(levels) < MAX_LEVELS:
        sizes = now.groupBy("scope").count().filter(F.col("count") > limit)
        large = sizes.select("scope", F.ceil(F.col("count") / limit).alias("parts")).collect()  # at most a row per limit edges
        at = _prioritized(now, len(levels) + 1)
        if not large:
            done = _merged(at.withColumn("part", F.lit(0)), limit).select("scope", "record", "least")
            break
        parts = edges.sparkSession.createDataFrame(large, "scope string, parts bigint")
        stars = _merged(_spread(at, parts, limit), limit)
        # the roots of a record, one per partition that has it; the first one is followed, the others are linked to it
        roots = F.sort_array(F.collect_set(F.struct(F.xxhash64("root", F.lit(len(levels) + 1)).alias("h"), "root", "least")))
        level = cut(stars.groupBy("scope", "record").agg(roots.alias("roots")))
        levels.append(level.select("scope", "record", F.col("roots")[0]["root"].alias("root"), F.col("roots")[0]["least"].alias("least")))
        links = level.filter(F.size("roots") > 1).select("scope", F.col("roots")[0].alias("x"), F.explode(F.slice("roots", 2, F.size("roots"))).alias("y"))
        now = cut(links.select("scope", F.col("x.root").alias("a"), F.col("y.root").alias("b"), F.col("x.least").alias("la"), F.col("y.least").alias("lb")).distinct())
    else:
        raise RuntimeError("links do not get fewer")
    for level in reversed(levels):
        done = _follow(level, cut(done), limit)
    return done.select("scope", "record", F.col("least").alias("group_id"))
