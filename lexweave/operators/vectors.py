"""Nearest neighbours among section vectors: by position, and over a whole document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.graph import top_k

#: Characters of the encoder's window.
WINDOW = 8_000
#: Vectors of one block in the global search, and most blocks of queries that a group is cut into.
BLOCK = 4_096


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def encode(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], name: str = "vec", compat: bool = False) -> DataFrame:
    """df with unit vectors of text by a given model.

    Longer texts are encoded in pieces of the encoder's window, whose unit vectors are averaged by their lengths;
    with compat=True only the first WINDOW characters count.
    """

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            texts = [(x or "")[: WINDOW if compat else None] for x in p]
            pieces = [[x[at : at + WINDOW] for at in range(0, max(len(x), 1), WINDOW)] for x in texts]
            v = unit(np.asarray(model([x for xs in pieces for x in xs]), dtype=np.float32))
            weighted = v * np.array([max(len(x), 1) for xs in pieces for x in xs], dtype=np.float32)[:, None]
            starts = np.cumsum([0, *map(len, pieces[:-1])])
            yield pd.Series(list(unit(np.add.reduceat(weighted, starts, axis=0))))

    return df.withColumn(name, run(text))


def window_knn(vectors: DataFrame, queries: DataFrame, window: int = 1, k: int = 5, min_sim: float = 0.35) -> DataFrame:
    """(doc_id, src, dst, anchor, score, rank, method): of the neighbours within window positions the k nearest, then those of at least min_sim.

    vectors: (doc_id, sec_id, idx, vec); queries: the same, and perhaps anchor, their order, which else is idx. The band is an equi-join on doc and
    shifted position, not a nested loop.
    """
    shifts = F.explode(F.array(*[F.lit(i) for i in range(-window, window + 1) if i]))
    q = _anchored(queries).select("doc_id", F.col("sec_id").alias("src"), "anchor", F.col("vec").alias("qv"), "idx", shifts.alias("_shift")).withColumn("idx", F.col("idx") + F.col("_shift"))
    j = q.join(vectors.select("doc_id", "idx", F.col("sec_id").alias("dst"), "vec"), ["doc_id", "idx"])
    j = j.select("doc_id", "src", "anchor", "dst", "idx", cosine(F.col("qv"), F.col("vec")).alias("score"))
    best = top_k(j, ["doc_id", "src"], [F.desc("score"), F.col("idx")], k)
    return best.filter(F.col("score") >= min_sim).select("doc_id", "src", "dst", "anchor", "score", "rank", F.lit("implicit_knn_window").alias("method"))


def _anchored(queries: DataFrame) -> DataFrame:
    return queries if "anchor" in queries.columns else queries.withColumn("anchor", F.col("idx"))


def global_knn(vectors: DataFrame, queries: DataFrame, window: int = 1, k: int = 5, min_sim: float = 0.35, block: int = BLOCK) -> DataFrame:
    """The same over all vectors of the document outside the window, exactly.

    Queries are a stated set (anchors, a few per document). Both sides are cut into blocks; every pair of a query block
    and a vector block is one matrix product in one task, of which only the k best per query leave.
    """
    salted = lambda df, by: df.withColumn("_b", F.floor(F.col("idx") / block).cast("int")) if by else df
    v, q = salted(vectors, True), queries
    blocks = v.select("doc_id", "_b").distinct()
    spread = q.join(blocks, "doc_id").select("doc_id", "_b", "sec_id", "idx", "vec", F.lit(1).alias("_q"))
    both = v.select("doc_id", "_b", "sec_id", "idx", "vec", F.lit(0).alias("_q")).unionByName(spread)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["_q"] == 1], g[g["_q"] == 0]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ("doc_id", "src", "dst", "idx", "score")}, dtype=object)
        x, y = (np.stack(p["vec"].to_numpy()).astype(np.float64) for p in (a, b))
        bi, out = b["idx"].to_numpy(), []
        order = np.argsort(bi, kind="stable")
        for at in range(0, len(a), 512):
            s = x[at : at + 512] @ y.T
            s[np.abs(a["idx"].to_numpy()[at : at + 512, None] - bi[None, :]) <= window] = -np.inf
            for i, row in enumerate(s):
                top = order[np.argsort(-row[order], kind="stable")[:k]]
                top = top[np.isfinite(row[top])]
                out.append(pd.DataFrame({"doc_id": a["doc_id"].iloc[0], "src": a["sec_id"].iloc[at + i], "dst": b["sec_id"].to_numpy()[top], "idx": bi[top], "score": row[top]}))
        return pd.concat(out)

    found = both.groupBy("doc_id", "_b").applyInPandas(run, f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, src {vectors.schema['sec_id'].dataType.simpleString()}, dst {vectors.schema['sec_id'].dataType.simpleString()}, idx int, score double")
    best = top_k(found, ["doc_id", "src"], [F.desc("score"), F.col("idx")], k)
    best = best.filter(F.col("score") >= min_sim).join(_anchored(queries).select("doc_id", F.col("sec_id").alias("src"), "anchor"), ["doc_id", "src"])
    return best.select("doc_id", "src", "dst", "anchor", "score", "rank", F.lit("implicit_knn_global").alias("method"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Edges and their reverses (method suffix ``_bidir``); of equal (src, dst) the first stays.

    The order is that in which edges are made: by anchor, of each the window's edges before the global ones, by rank,
    each followed by its reverse.
    """
    back = edges.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "anchor", "score", "rank", F.concat("method", F.lit("_bidir")).alias("method"))
    order = F.struct("anchor", (~F.col("method").contains("window")).alias("g"), "rank", F.col("method").endswith("_bidir").alias("b"), "score", "method")
    best = edges.unionByName(back).groupBy("doc_id", "src", "dst").agg(F.min(order).alias("o"))
    return best.select("doc_id", "src", "dst", "o.score", "o.rank", "o.method")


def query_vectors(sections: DataFrame, gists: DataFrame) -> DataFrame:
    """Per section its gist's vector where there is one, else its own: (doc_id, sec_id, idx, vec)."""
    g = gists.select("doc_id", "sec_id", F.col("vec").alias("gv"))
    return sections.join(g, ["doc_id", "sec_id"], "left").select("doc_id", "sec_id", "idx", F.coalesce("gv", "vec").alias("vec"))
