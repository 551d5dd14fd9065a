"""Section graphs: degrees, strength, density, PageRank, components, clustering, merging of edge kinds.

All functions work on all documents at once; an edge never leaves its doc_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexweave.session import cut


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", F.explode(F.array("src_sec_id", "dst_sec_id")).alias("sec_id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(doc_id, sec_id, in_degree, out_degree, in_span_strength); a self-loop counts in both degrees."""
    ends = F.array(
        F.struct(F.col("src_sec_id").alias("sec_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("bigint").alias("s")),
        F.struct(F.col("dst_sec_id").alias("sec_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("span_count").alias("s")),
    )
    e = edges.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.*")
    return e.groupBy("doc_id", "sec_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("s").alias("in_span_strength"))


def counts(edges: DataFrame) -> DataFrame:
    """(doc_id, num_nodes, num_edges, density): density m / (n (n - 1)), self-loops counted in m, 0 for one node."""
    n = nodes(edges).groupBy("doc_id").agg(F.count("*").alias("num_nodes"))
    m = edges.groupBy("doc_id").agg(F.count("*").alias("num_edges"))
    pairs = F.col("num_nodes") * (F.col("num_nodes") - 1)
    return n.join(m, "doc_id").withColumn("density", F.when(pairs > 0, F.col("num_edges") / pairs).otherwise(0.0))


#: Most edges of one document whose ranks are iterated inside one task.
MAX_TASK_EDGES = 2_000_000


def _ranks_of_one(alpha: float, rounds: int, tolerance: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(np.concatenate([group["src_sec_id"], group["dst_sec_id"]]), return_inverse=True)
        n, m = len(ids), len(group)
        src, dst = codes[:m], codes[m:]
        out = np.bincount(src, minlength=n)
        rank = np.full(n, 1.0 / n)
        share = np.divide(1.0, out, out=np.zeros(n), where=out > 0)
        for _ in range(rounds):
            old = rank
            got = np.bincount(dst, weights=(old * share)[src], minlength=n)
            rank = (1 - alpha) / n + alpha * (got + old[out == 0].sum() / n)
            if np.abs(rank - old).sum() <= tolerance * n:
                break
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[0], "sec_id": ids, "pagerank": rank})

    return run


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(doc_id, sec_id, pagerank), unweighted, per document; the mass of nodes without out-edges is spread evenly.

    A document's rounds end when its ranks changed by at most tolerance times its nodes in one. Documents of up to
    max_task_edges edges iterate inside one task each, in one shuffle; larger ones by distributed rounds, with the same
    result.
    """
    links = edges.select("doc_id", "src_sec_id", "dst_sec_id").dropna().distinct()
    sizes = links.groupBy("doc_id").agg(F.count("*").alias("m"))
    large = sizes.filter(F.col("m") > max_task_edges).select("doc_id")
    run = _ranks_of_one(alpha, rounds, tolerance)
    schema = "doc_id string, sec_id string, pagerank double"
    if (sizes.agg(F.max("m")).first()[0] or 0) <= max_task_edges:
        return links.groupBy("doc_id").applyInPandas(run, schema)
    small = links.join(large, "doc_id", "left_anti").groupBy("doc_id").applyInPandas(run, schema)
    return small.unionByName(pagerank_rounds(links.join(large, "doc_id", "left_semi"), alpha, rounds, tolerance))


def pagerank_rounds(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """The same by rounds of joins over the cluster, for documents of any size.

    Ranks of a document stay as they are after the round in which its rounds end. Every round ends in a checkpoint, as
    the next one reads it several times, and the driver asks whether any document goes on.
    """
    out = edges.groupBy("doc_id", "src_sec_id").agg(F.count("*").alias("out"))
    size = nodes(edges).groupBy("doc_id").agg(F.count("*").alias("n"))
    base = nodes(edges).join(size, "doc_id").join(out.withColumnRenamed("src_sec_id", "sec_id"), ["doc_id", "sec_id"], "left")
    base = cut(base.select("doc_id", "sec_id", "n", F.coalesce("out", F.lit(0)).alias("out")))
    links = cut(edges.select("doc_id", "src_sec_id", "dst_sec_id"))
    rank = base.withColumns({"r": 1 / F.col("n"), "live": F.lit(True)})
    for _ in range(rounds):
        loose = rank.groupBy("doc_id").agg(F.sum(F.when(F.col("out") == 0, F.col("r")).otherwise(0.0)).alias("loose"))
        given = rank.filter("out > 0").select("doc_id", F.col("sec_id").alias("src_sec_id"), (F.col("r") / F.col("out")).alias("g"))
        got = links.join(given, ["doc_id", "src_sec_id"]).groupBy("doc_id", F.col("dst_sec_id").alias("sec_id")).agg(F.sum("g").alias("g"))
        new = rank.withColumnRenamed("r", "old").join(got, ["doc_id", "sec_id"], "left").join(loose, "doc_id")
        next_rank = (1 - alpha) / F.col("n") + alpha * (F.coalesce("g", F.lit(0.0)) + F.col("loose") / F.col("n"))
        new = new.withColumn("r", F.when(F.col("live"), next_rank).otherwise(F.col("old"))).drop("g", "loose")
        new = cut(new.select("doc_id", "sec_id", "n", "out", "old", "r", "live"))
        moved = new.groupBy("doc_id").agg((F.sum(F.abs(F.col("r") - F.col("old"))) / F.max("n") > tolerance).alias("moves"))
        rank = new.join(moved, "doc_id").select("doc_id", "sec_id", "n", "out", "r", (F.col("live") & F.col("moves")).alias("live"))
        if rank.filter("live").isEmpty():
            break
    return rank.select("doc_id", "sec_id", F.col("r").alias("pagerank"))


def star_contraction(edges: DataFrame) -> DataFrame:
    """(scope, a, b): of every record that is not the smallest of its component, that smallest one as b.

    edges: (scope, a, b). Alternates large-star and small-star, each a shuffle that needs only a record and the
    minimum of its neighbours, until nothing changes; the number of rounds grows with the logarithm of the size.
    """
    edges = cut(edges.filter("a <> b").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("scope", "a").agg(F.min("b").alias("m")).select("scope", "a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, ["scope", "a"]).select("scope", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("scope", "a").agg(F.min("b").alias("m"))
        more = large.join(low, ["scope", "a"]).filter("b <> m").select("scope", F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(more.unionByName(low.select("scope", "a", F.col("m").alias("b"))).filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("scope", "a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges
        last = state


def _components_of_one(group: pd.DataFrame) -> pd.DataFrame:
    ids, codes = np.unique(np.concatenate([group["src_sec_id"], group["dst_sec_id"]]), return_inverse=True)
    a, b, least = codes[: len(group)], codes[len(group) :], np.arange(len(ids))
    while (least[a] != least[b]).any():
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        np.minimum.at(least, high, low)
        while (least != (up := least[least])).any():
            least = up
    return pd.DataFrame({"doc_id": group["doc_id"].iloc[0], "sec_id": ids, "component": ids[least]})


def components(edges: DataFrame, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(doc_id, sec_id, component): weakly connected components, named by their smallest section.

    Documents of up to max_task_edges edges are done inside one task each, in one shuffle; larger ones by star
    contraction over the cluster, with the same result.
    """
    links = edges.select("doc_id", "src_sec_id", "dst_sec_id").dropna()
    sizes = links.groupBy("doc_id").agg(F.count("*").alias("m"))
    schema = "doc_id string, sec_id string, component string"
    if (sizes.agg(F.max("m")).first()[0] or 0) <= max_task_edges:
        return links.groupBy("doc_id").applyInPandas(_components_of_one, schema)
    large = sizes.filter(F.col("m") > max_task_edges).select("doc_id")
    small = links.join(large, "doc_id", "left_anti").groupBy("doc_id").applyInPandas(_components_of_one, schema)
    giant = links.join(large, "doc_id", "left_semi")
    roots = star_contraction(giant.select(F.col("doc_id").alias("scope"), F.col("src_sec_id").alias("a"), F.col("dst_sec_id").alias("b")))
    roots = roots.select(F.col("scope").alias("doc_id"), F.col("a").alias("sec_id"), "b")
    return small.unionByName(nodes(giant).join(roots, ["doc_id", "sec_id"], "left").select("doc_id", "sec_id", F.coalesce("b", "sec_id").alias("component")))


def node_table(edges: DataFrame, **options: float) -> DataFrame:
    """(doc_id, sec_id, pagerank, in_degree, out_degree, in_span_strength) of every node; options: see pagerank."""
    return pagerank(edges, **options).join(degrees(edges), ["doc_id", "sec_id"]).select("doc_id", "sec_id", "pagerank", "in_degree", "out_degree", "in_span_strength")


def clustering(edges: DataFrame) -> DataFrame:
    """(doc_id, avg_clustering) of the undirected graph without self-loops, over all nodes (fewer than two neighbours: 0).

    Edges point from the smaller to the larger (degree, id), so no node opens more than the square root of twice the
    edges, and hubs make no wedge explosion.
    """
    every = nodes(edges)
    u = edges.filter("src_sec_id <> dst_sec_id").select("doc_id", F.least("src_sec_id", "dst_sec_id").alias("a"), F.greatest("src_sec_id", "dst_sec_id").alias("b")).distinct()
    deg = u.select("doc_id", F.explode(F.array("a", "b")).alias("sec_id")).groupBy("doc_id", "sec_id").agg(F.count("*").alias("k"))
    da, db = (deg.select("doc_id", F.col("sec_id").alias(x), F.col("k").alias("k" + x)) for x in "ab")
    d = u.join(da, ["doc_id", "a"]).join(db, ["doc_id", "b"])
    first = F.struct("ka", "a") < F.struct("kb", "b")
    d = d.select("doc_id", F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedges = d.alias("x").join(d.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.t") < F.col("y.t")))
    wedges = wedges.select("x.doc_id", F.col("x.s").alias("s"), F.col("x.t").alias("a"), F.col("y.t").alias("b"))
    triangles = wedges.join(u, ["doc_id", "a", "b"], "left_semi")
    t = triangles.select("doc_id", F.explode(F.array("s", "a", "b")).alias("sec_id")).groupBy("doc_id", "sec_id").agg(F.count("*").alias("t"))
    c = every.join(deg, ["doc_id", "sec_id"], "left").join(t, ["doc_id", "sec_id"], "left")
    own = F.when(F.col("k") >= 2, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return c.groupBy("doc_id").agg(F.avg(own).alias("avg_clustering"))


def merge_edges(explicit: DataFrame, implicit: DataFrame) -> DataFrame:
    """(doc_id, src_sec_id, dst_sec_id, edge_type, score, weight): of each pair the heaviest edge, explicit ones at equal weight.

    Explicit edges weigh 1, implicit ones 0.4 times their score (0.4 without one); self-loops are left out.
    """
    e = explicit.select("doc_id", "src_sec_id", "dst_sec_id", F.lit("explicit").alias("edge_type"), F.lit(None).cast("double").alias("score"))
    i = implicit.select("doc_id", "src_sec_id", "dst_sec_id", F.lit("implicit").alias("edge_type"), F.when(~F.isnan("score"), F.col("score")).alias("score"))
    all_edges = e.unionByName(i).filter("src_sec_id <> dst_sec_id")
    weight = F.when(F.col("edge_type") == "explicit", 1.0).otherwise(0.4 * F.coalesce("score", F.lit(1.0)))
    best = all_edges.withColumn("weight", weight).groupBy("doc_id", "src_sec_id", "dst_sec_id")
    picked = best.agg(F.min(F.struct((-F.col("weight")).alias("w"), "edge_type", "score")).alias("b"))
    return picked.select("doc_id", "src_sec_id", "dst_sec_id", "b.edge_type", "b.score", (-F.col("b.w")).alias("weight"))


def centrality(merged: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, sec_id, in_weight, out_weight, centrality) of all sections; centrality is in_weight over the document's largest."""
    ins = merged.groupBy("doc_id", F.col("dst_sec_id").alias("sec_id")).agg(F.sum("weight").alias("in_weight"))
    outs = merged.groupBy("doc_id", F.col("src_sec_id").alias("sec_id")).agg(F.sum("weight").alias("out_weight"))
    j = sections.select("doc_id", "sec_id").distinct().join(ins, ["doc_id", "sec_id"], "left").join(outs, ["doc_id", "sec_id"], "left").fillna(0.0)
    top = j.groupBy("doc_id").agg(F.greatest(F.lit(1e-9), F.max("in_weight")).alias("m"))
    return j.join(top, "doc_id").select("doc_id", "sec_id", "in_weight", "out_weight", (F.col("in_weight") / F.col("m")).alias("centrality"))


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of every group; Spark limits each group before the shuffle."""
    w = W.Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
