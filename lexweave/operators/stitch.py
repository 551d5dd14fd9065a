"""Stitching of anchors and neighbours into a plan, rendering under a budget, refining."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexweave.functions import text as t
from lexweave.operators.graph import top_k


def stitch_plan(anchors: DataFrame, merged: DataFrame, centrality: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, pos, sec_id, role): anchors by rank, each followed by its k best neighbours; a section keeps its first place.

    anchors: (doc_id, sec_id, rank); neighbours are ranked by edge weight plus a quarter of their centrality.
    """
    c = centrality.select("doc_id", F.col("sec_id").alias("dst_sec_id"), "centrality")
    near = merged.join(anchors.select("doc_id", F.col("sec_id").alias("src_sec_id"), F.col("rank").alias("a")), ["doc_id", "src_sec_id"]).join(c, ["doc_id", "dst_sec_id"], "left")
    near = near.withColumn("prior", F.round(F.col("weight") + 0.25 * F.coalesce("centrality", F.lit(0.0)), 9))
    near = top_k(near, ["doc_id", "src_sec_id", "a"], [F.desc("prior"), F.col("dst_sec_id")], k)
    items = anchors.select("doc_id", F.col("rank").alias("a"), F.lit(0).alias("b"), "sec_id").unionByName(near.select("doc_id", "a", F.col("rank").alias("b"), F.col("dst_sec_id").alias("sec_id")))
    first = items.groupBy("doc_id", "sec_id").agg(F.min(F.struct("a", "b")).alias("p"))
    order = W.Window.partitionBy("doc_id").orderBy("p")
    return first.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "sec_id", F.when(F.col("p.b") == 0, "anchor").otherwise("neighbor").alias("role"))


def lead_sentences(c: Column) -> Column:
    """The first two pieces that '. ' parts, with a full stop."""
    pieces = F.slice(F.split(F.coalesce(c, F.lit("")), r"\. ", 3), 1, 2)
    joined = F.array_join(pieces, ". ")
    return F.when(~joined.rlike(t.NO_WS), "").otherwise(F.concat(F.regexp_replace(joined, r"\.+$", ""), F.lit(".")))


def leads(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_id, heading, lead): what rendering needs of sections."""
    return sections.select("doc_id", "sec_id", "heading", lead_sentences(F.col("text")).alias("lead"))


def render(plan: DataFrame, sections: DataFrame, gists: DataFrame, budget: int = 1200) -> DataFrame:
    """(doc_id, summary_text, words, blocks): blocks in plan order under a word budget; a block that does not fit is skipped, later ones may fit."""
    return render_leads(plan, leads(sections), gists, budget)


def _fitting(budget: int):
    """Rows (doc_id, pos, n, block), in order, to those that fit; where none does, a row without block tells the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, total, kept = None, 0, 0
        for batch in batches:
            keep, told = [], []
            for i, (d, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if d != doc:
                    if doc is not None and not kept:
                        told.append(doc)
                    doc, total, kept = d, 0, 0
                if total + n <= budget:
                    total, kept = total + n, kept + 1
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))
            if told:
                yield _nothing(told, batch.schema)
            schema = batch.schema
        if doc is not None and not kept:
            yield _nothing([doc], schema)

    return run


def _nothing(docs: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, schema.field(0).type), *[pa.nulls(len(docs), f.type) for f in list(schema)[1:]]], names=schema.names)


def render_leads(plan: DataFrame, leads: DataFrame, gists: DataFrame, budget: int = 1200) -> DataFrame:
    """render from leads instead of sections.

    Blocks are made once and pass the fold in plan order, a document after the other, one row at a time; only those
    picked, whose words are at most the budget, are gathered.
    """
    j = plan.join(leads, ["doc_id", "sec_id"]).join(gists.select("doc_id", F.col("anchor_sec_id").alias("sec_id"), "gist_text"), ["doc_id", "sec_id"], "left")
    text = F.when(F.coalesce("gist_text", F.lit("")) != "", F.col("gist_text")).otherwise(F.col("lead"))
    j = j.select("doc_id", F.col("pos").cast("int").alias("pos"), "sec_id", F.coalesce("heading", F.lit("")).alias("heading"), text.alias("text")).filter("text <> ''")
    block = F.concat_ws("", "sec_id", F.lit(" — "), "heading", F.lit("\n"), "text", F.lit("\n"))
    blocks = j.select("doc_id", "pos", t.token_count(F.col("text")).alias("n"), block.alias("block")).repartition("doc_id").sortWithinPartitions("doc_id", "pos", "n")
    picked = blocks.mapInArrow(_fitting(budget), "doc_id string, pos int, n int, block string")
    out = picked.groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("words"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "block")))).alias("b"))
    footer = F.concat(F.lit("\n[approx tokens used: "), F.col("words").cast("string"), F.lit("]"))
    text = F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n"), footer)
    return out.select("doc_id", text.alias("summary_text"), "words", F.size("b").alias("blocks"))


def deliverable(plan: DataFrame, summaries: DataFrame) -> DataFrame:
    """(doc_id, json): plan and summary text of every document as one JSON object."""
    p = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sec_id", "role"))).alias("a"))
    anchors = F.transform("a", lambda x: F.struct(x["sec_id"].alias("sec_id"), x["role"].alias("role")))
    return p.join(summaries, "doc_id").select("doc_id", F.to_json(F.struct("doc_id", anchors.alias("anchors"), "summary_text")).alias("json"))


def refine(c: Column, budget_words: int) -> Column:
    """Refinement without a model: garbled sequences, citation spacing, word cap."""
    return t.word_cap(t.citation_spacing(t.fix_garbled(c)), budget_words)


def refine_context(plan: DataFrame, sections: DataFrame, gists: DataFrame, most: int = 18) -> DataFrame:
    """(doc_id, context): of each plan the first entries of the document's own part, with heading and gist."""
    part = F.regexp_extract("doc_id", r"_([0-9]+)$", 1)
    own = top_k(plan.filter(F.startswith("sec_id", F.concat(F.lit("§"), part, F.lit(".")))), ["doc_id"], [F.col("pos")], most)
    j = own.join(sections.select("doc_id", "sec_id", "heading"), ["doc_id", "sec_id"], "left").join(gists.select("doc_id", F.col("anchor_sec_id").alias("sec_id"), "gist_text"), ["doc_id", "sec_id"], "left")
    line = F.concat_ws("", "sec_id", F.lit(" — "), F.coalesce("heading", F.lit("")), F.lit("\n"), F.coalesce("gist_text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("l"))))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n\n").alias("context"))


def prompt(context: Column, part_prefix: Column, budget_words: int) -> Column:
    """The text given to a model that refines, if one is plugged in."""
    return F.concat(F.lit(f"Write at most {budget_words} words. Cite sections as (§n.m), only those that start with "), part_prefix, F.lit(".\n\n"), context)
