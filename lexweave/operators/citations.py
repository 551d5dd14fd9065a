"""Citations: extraction from text, spans, edges and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.functions.keys import section_id


def single_refs(c: Column) -> Column:
    return F.transform(t.all_groups(c, t.SINGLE, 1), lambda x: F.concat(F.lit("§"), x))


def range_refs(c: Column, pattern: str = t.RANGE) -> Column:
    pairs = F.arrays_zip(t.all_groups(c, pattern, 1).alias("a"), t.all_groups(c, pattern, 2).alias("b"))
    return F.transform(F.flatten(F.transform(pairs, lambda p: t.expand_range(p["a"], p["b"]))), lambda x: F.concat(F.lit("§"), x))


def inword_refs(c: Column) -> Column:
    return F.transform(t.all_groups(c, t.INWORD, 1), lambda x: F.concat(F.lit("§"), x))


def crossdoc_refs(c: Column) -> Column:
    def both(pattern: str, between: str) -> Column:
        return F.zip_with(t.all_groups(c, pattern, 1), t.all_groups(c, pattern, 2), lambda a, b: F.concat(a, F.lit(between), b))

    return F.concat(both(t.CFR_SECTION, "CFR §"), both(t.CFR_PART, "CFR part "))


def all_refs(c: Column, mode: str = "rich", pattern: str = t.RANGE) -> Column:
    """Distinct references of a text in code point order; ``simple`` leaves the cross-title ones out. Null text: none."""
    parts = [single_refs(c), range_refs(c, pattern), inword_refs(c)] + ([crossdoc_refs(c)] if mode == "rich" else [])
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*parts))), F.array().cast("array<string>"))


#: Kinds of spans with their patterns, in the order in which equal spans are kept.
SPAN_KINDS = (("range", t.RANGE), ("local", t.SINGLE), ("inword", t.INWORD), ("cfr_sec", t.CFR_SECTION), ("cfr_part", t.CFR_PART))


def ref_spans(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., ref_text, span_start, span_end, kind): every match with code point offsets, each (start, end, text) once."""
    found = []
    for rank, (kind, pattern) in enumerate(SPAN_KINDS):
        m, parts = t.all_groups(F.col(text), pattern, 0), F.split(F.col(text), pattern, -1)
        base = df.select(*keys, m.alias("_m"), F.transform(m, lambda x: F.length(x)).alias("_ml"), F.transform(parts, lambda x: F.length(x)).alias("_pl"))
        base = base.select(*keys, "_ml", "_pl", F.posexplode("_m").alias("_i", "ref_text"))
        total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)
        start = total(F.col("_pl"), F.col("_i") + 1) + total(F.col("_ml"), F.col("_i"))
        found.append(base.select(*keys, "ref_text", start.alias("span_start"), F.lit(rank).alias("_rank")))
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    spans = spans.groupBy(*keys, "ref_text", "span_start").agg(F.min("_rank").alias("_rank"))
    kinds = F.array(*[F.lit(k) for k, _ in SPAN_KINDS])
    return spans.select(*keys, "ref_text", "span_start", (F.col("span_start") + F.length("ref_text")).alias("span_end"), F.element_at(kinds, F.col("_rank") + 1).alias("kind"))


def exact_edges(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, src_sec_id, dst_sec_id): references that name an existing section of the same document exactly."""
    ids = sections.select("doc_id", "sec_id").distinct()
    edges = refs.select("doc_id", F.col("sec_id").alias("src_sec_id"), F.explode("explicit_refs").alias("dst_sec_id"))
    edges = edges.filter(F.col("dst_sec_id").rlike(r"^§\d{1,3}\.\d{1,3}") & (F.col("src_sec_id") != F.col("dst_sec_id"))).distinct()
    for end in ("src_sec_id", "dst_sec_id"):
        edges = edges.join(ids.withColumnRenamed("sec_id", end), ["doc_id", end], "left_semi")
    return edges


def _section_links(flat: DataFrame) -> DataFrame:
    """Flat citations between sections: paragraphs fold into their section, cross-title citations are left out."""
    return flat.filter("match_kind IS NULL OR match_kind <> 'crossdoc'").select(
        "doc_id", section_id(F.col("src_sec_id")).alias("src_sec_id"), section_id(F.col("norm_token")).alias("dst_sec_id"), "ref_id", "match_text"
    ).dropna(subset=["doc_id", "src_sec_id", "dst_sec_id"])


def edge_counts(flat: DataFrame) -> DataFrame:
    """(doc_id, src_sec_id, dst_sec_id, span_count): base_edges without examples, in one shuffle of counts."""
    return _section_links(flat).groupBy("doc_id", "src_sec_id", "dst_sec_id").agg(F.count("*").alias("span_count"))


def base_edges(flat: DataFrame, min_span_count: int = 1) -> DataFrame:
    """The canonical edge table (doc_id, src_sec_id, dst_sec_id, span_count, examples, weight) of flat citations.

    Paragraphs fold into their section, cross-title citations are left out, self-loops stay; examples are the first
    three distinct texts by ref_id.
    """
    texts = _section_links(flat).groupBy("doc_id", "src_sec_id", "dst_sec_id", "match_text").agg(F.count("*").alias("n"), F.min("ref_id").alias("first"))
    listed = F.array_sort(F.collect_list(F.when(F.col("match_text").isNotNull(), F.struct("first", "match_text"))))
    out = texts.groupBy("doc_id", "src_sec_id", "dst_sec_id").agg(F.sum("n").alias("span_count"), F.slice(F.transform(listed, lambda x: x["match_text"]), 1, 3).alias("examples"))
    return out.filter(F.col("span_count") >= min_span_count).withColumn("weight", F.lit(1.0))


def ref_score(left: DataFrame, right: DataFrame) -> DataFrame:
    """Agreement of two reference arrays per (doc_id, sec_id), driven by left; f1 is 1 where nothing agrees, f1_strict 0."""
    e = F.array().cast("array<string>")
    j = left.select("doc_id", "sec_id", F.array_distinct(F.coalesce("refs", e)).alias("l")).join(right.select("doc_id", "sec_id", F.array_distinct(F.coalesce("refs", e)).alias("r")), ["doc_id", "sec_id"], "left")
    j = j.withColumn("r", F.coalesce("r", e))
    nl, nr, both = F.size("l"), F.size("r"), F.size(F.array_intersect("l", "r"))
    p = F.when(nr > 0, both / nr).otherwise(F.when(nl == 0, 1.0).otherwise(0.0))
    r = F.when(nl > 0, both / nl).otherwise(F.when(nr == 0, 1.0).otherwise(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(1.0)
    return j.select(
        "doc_id", "sec_id", nl.alias("xml_refs"), nr.alias("pdf_refs"), both.alias("overlap"), (nl - both).alias("only_xml"), (nr - both).alias("only_pdf"),
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.when(p + r > 0, f1).otherwise(0.0), 6).alias("f1_strict"),
    )
