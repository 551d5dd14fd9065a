"""Queries of citations and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.functions.keys import section_id
from lexweave.operators import citations as c
from lexweave.operators import graph as g
from lexweave.plans import oracle_parts as o
from lexweave.session import cut, table


def canonical_sections(spark: SparkSession, d: str) -> DataFrame:
    """One row per (doc_id, sec_id): the first parse (smallest idx, then sec_key) wins."""
    return _first_parses(table(spark, d, "sections"))


def whole_documents(spark: SparkSession, d: str, large: DataFrame | None = None) -> DataFrame:
    """canonical_sections with the rows of a document one after the other in one partition; large: doc_ids left out."""
    s = table(spark, d, "sections").select("doc_id", "sec_id", "idx", "sec_key", "label", "heading", "text", "tokens")
    s = s if large is None else s.join(large, "doc_id", "left_anti")
    return _first_parses(s.repartition("doc_id")).sortWithinPartitions("doc_id")


def whole_documents_with(spark: SparkSession, d: str, other: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, sec_id, heading, text, columns...) of the canonical sections that other has, a document in one partition.

    A union takes the place of the join, which would shuffle the texts by section.
    """
    s = table(spark, d, "sections").withColumn("sec_id", section_id(F.col("sec_id"))).filter("sec_id IS NOT NULL AND doc_id IS NOT NULL")
    s = s.select("doc_id", "sec_id", F.struct("idx", "sec_key", "label", "heading", "text", "tokens").alias("b"))
    both = s.unionByName(other.select("doc_id", "sec_id", F.struct(*columns).alias("o")), allowMissingColumns=True).repartition("doc_id")
    j = both.groupBy("doc_id", "sec_id").agg(F.min("b").alias("b"), F.max("o").alias("o")).filter("b IS NOT NULL AND o IS NOT NULL")
    return j.select("doc_id", "sec_id", "b.heading", "b.text", "o.*")


def _first_parses(s: DataFrame) -> DataFrame:
    s = s.withColumn("sec_id", section_id(F.col("sec_id"))).filter("sec_id IS NOT NULL AND doc_id IS NOT NULL")
    best = s.groupBy("doc_id", "sec_id").agg(F.min(F.struct("idx", "sec_key", "label", "heading", "text", "tokens")).alias("b"))
    return best.select("doc_id", "sec_id", "b.*")


SECTIONS_SQL = f"""sec AS (SELECT * EXCLUDE (rn) FROM (SELECT doc_id, {o.section_id('sec_id')} AS sec_id, idx, sec_key, label, heading, text, tokens,
 row_number() OVER (PARTITION BY doc_id, {o.section_id('sec_id')} ORDER BY idx, sec_key) AS rn FROM sections) WHERE rn = 1 AND sec_id IS NOT NULL AND doc_id IS NOT NULL)"""
BASE_SQL = f"""base AS (SELECT doc_id, src_sec_id, dst_sec_id, count(*) AS span_count FROM (
 SELECT doc_id, {o.section_id('src_sec_id')} AS src_sec_id, {o.section_id('norm_token')} AS dst_sec_id FROM explicit_refs_flat WHERE match_kind IS DISTINCT FROM 'crossdoc')
 WHERE doc_id IS NOT NULL AND src_sec_id IS NOT NULL AND dst_sec_id IS NOT NULL GROUP BY ALL)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return c.base_edges(table(spark, d, "explicit_refs_flat"))


def most_cited(spark: SparkSession, d: str) -> DataFrame:
    """The three most cited sections of every regulation."""
    ranked = g.degrees(edges(spark, d))
    order = [F.desc("in_span_strength"), F.desc("in_degree"), F.col("sec_id")]
    return g.top_k(ranked, ["doc_id"], order, 3).select("doc_id", "rank", "sec_id", "in_degree", "in_span_strength")


def _counted(column):
    """One row per reference with its number of occurrences, over all section texts."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        refs = table(spark, d, "sections").select("doc_id", F.explode(column(F.col("text"))).alias("ref"))
        return refs.groupBy("doc_id", "ref").agg(F.count("*").alias("n"))

    return query


def refs_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("sec_key", F.array_join(c.all_refs(F.col("text")), "|").alias("refs"))


def ref_spans(spark: SparkSession, d: str) -> DataFrame:
    return c.ref_spans(table(spark, d, "sections").select("sec_key", "text"), ["sec_key"], "text")


def flat_refs(spark: SparkSession, d: str) -> DataFrame:
    """One row per citation and, for ranges, per member; cross-title citations keep their title."""
    spans = ref_spans(spark, d)
    a, b = F.regexp_extract("ref_text", t.RANGE, 1), F.regexp_extract("ref_text", t.RANGE, 2)
    token = (
        F.when(F.col("kind") == "range", F.transform(t.expand_range(a, b), lambda x: F.concat(F.lit("§"), x)))
        .when(F.col("kind") == "local", c.single_refs(F.col("ref_text")))
        .when(F.col("kind") == "inword", c.inword_refs(F.col("ref_text")))
        .otherwise(c.crossdoc_refs(F.col("ref_text")))
    )
    return spans.select("sec_key", "ref_text", "kind", "span_start", "span_end", F.explode(token).alias("norm_token"))


def edges_exact(spark: SparkSession, d: str) -> DataFrame:
    return c.exact_edges(table(spark, d, "xml_refs"), canonical_sections(spark, d))


def edges_base(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("doc_id", "src_sec_id", "dst_sec_id", "span_count", F.array_join("examples", "|").alias("examples"))


def ref_score(spark: SparkSession, d: str) -> DataFrame:
    """References listed in xml_refs against those that the section text has."""
    left = table(spark, d, "xml_refs").groupBy("doc_id", "sec_id").agg(F.array_distinct(F.flatten(F.collect_list("explicit_refs"))).alias("refs"))
    right = canonical_sections(spark, d).select("doc_id", "sec_id", c.all_refs(F.col("text")).alias("refs"))
    return c.ref_score(left, right)


def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The reference's graph report of every regulation: nodes, edges, density, components, clustering."""
    e = cut(edges(spark, d))  # read once, used by four operators
    parts = g.components(e).groupBy("doc_id").agg(F.countDistinct("component").alias("components"))
    out = g.counts(e).join(parts, "doc_id").join(g.clustering(e), "doc_id")
    return out.select("doc_id", "num_nodes", "num_edges", F.round("density", 9).alias("density"), "components", F.round("avg_clustering", 9).alias("avg_clustering"))


#: PageRank of the queries goes on until seven decimals are sure.
RANK_TOLERANCE, RANK_ROUNDS = 1e-12, 200


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The reference's node table of every regulation."""
    return g.node_table(cut(edges(spark, d)), tolerance=RANK_TOLERANCE, rounds=RANK_ROUNDS).withColumn("pagerank", F.round("pagerank", 7))


QUERIES = {
    "most_cited": most_cited,
    "refs_single": _counted(c.single_refs),
    "refs_range": _counted(c.range_refs),
    "refs_inword": _counted(c.inword_refs),
    "refs_crossdoc": _counted(c.crossdoc_refs),
    "refs_normalized": refs_normalized,
    "ref_spans": ref_spans,
    "flat_refs": flat_refs,
    "edges_exact": edges_exact,
    "edges_base": edges_base,
    "ref_score": ref_score,
    "graph_degrees": lambda s, d: g.degrees(edges(s, d)),
    "graph_counts_density": lambda s, d: g.counts(edges(s, d)).withColumn("density", F.round("density", 9)),
    "in_strength": lambda s, d: g.degrees(edges(s, d)).select("doc_id", "sec_id", "in_span_strength"),
    "graph_pagerank": lambda s, d: g.pagerank(edges(s, d), tolerance=RANK_TOLERANCE, rounds=RANK_ROUNDS).withColumn("pagerank", F.round("pagerank", 7)),
    "graph_nodes": graph_nodes,
    "graph_components": lambda s, d: g.components(edges(s, d)),
    "graph_clustering": lambda s, d: g.clustering(edges(s, d)).withColumn("avg_clustering", F.round("avg_clustering", 9)),
    "graph_metrics_report": graph_metrics,
}

_DEG = """deg AS (SELECT doc_id, sec_id, sum(i) AS in_degree, sum(o) AS out_degree, sum(s) AS in_span_strength FROM (
 SELECT doc_id, src_sec_id AS sec_id, 0 AS i, 1 AS o, 0 AS s FROM base UNION ALL SELECT doc_id, dst_sec_id, 1, 0, span_count FROM base) GROUP BY ALL)"""
_NODES = "nod AS (SELECT doc_id, src_sec_id AS sec_id FROM base UNION SELECT doc_id, dst_sec_id FROM base)"
_CNT = "cnt AS (SELECT n.doc_id, num_nodes, num_edges, CASE WHEN num_nodes > 1 THEN num_edges / (num_nodes * (num_nodes - 1)) ELSE 0 END AS density FROM (SELECT doc_id, count(*) AS num_nodes FROM nod GROUP BY 1) n JOIN (SELECT doc_id, count(*) AS num_edges FROM base GROUP BY 1) m ON n.doc_id = m.doc_id)"
_CMP = """u AS (SELECT doc_id, src_sec_id AS a, dst_sec_id AS b FROM base UNION SELECT doc_id, dst_sec_id, src_sec_id FROM base UNION SELECT doc_id, sec_id, sec_id FROM nod),
r AS (SELECT doc_id, a, b FROM u UNION SELECT r.doc_id, r.a, u.b FROM r JOIN u ON r.doc_id = u.doc_id AND r.b = u.a),
cmp AS (SELECT doc_id, a AS sec_id, min(b) AS component FROM r GROUP BY ALL)"""
_CLU = """s AS (SELECT DISTINCT doc_id, src_sec_id AS a, dst_sec_id AS b FROM base WHERE src_sec_id <> dst_sec_id), v AS (SELECT doc_id, a, b FROM s UNION SELECT doc_id, b, a FROM s),
k AS (SELECT doc_id, a AS sec_id, count(*) AS k FROM v GROUP BY ALL),
w AS (SELECT x.doc_id, x.a AS sec_id, count(*) AS t FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.a = y.a AND x.b < y.b JOIN v z ON z.doc_id = x.doc_id AND z.a = x.b AND z.b = y.b GROUP BY ALL),
clu AS (SELECT nod.doc_id, avg(CASE WHEN k.k >= 2 THEN 2.0 * coalesce(w.t, 0) / (k.k * (k.k - 1)) ELSE 0 END) AS avg_clustering FROM nod LEFT JOIN k ON k.doc_id = nod.doc_id AND k.sec_id = nod.sec_id LEFT JOIN w ON w.doc_id = nod.doc_id AND w.sec_id = nod.sec_id GROUP BY 1)"""


_RANK = f"""od AS (SELECT doc_id, src_sec_id, count(*) AS k FROM base GROUP BY ALL),
nn AS (SELECT nod.doc_id, nod.sec_id, cnt.num_nodes AS n, coalesce(od.k, 0) AS k FROM nod JOIN cnt ON cnt.doc_id = nod.doc_id LEFT JOIN od ON od.doc_id = nod.doc_id AND od.src_sec_id = nod.sec_id),
pr AS (SELECT 0 AS i, doc_id, sec_id, n, k, 1.0::DOUBLE / n AS r FROM nn
 UNION ALL SELECT any_value(p.i) + 1, t.doc_id, t.sec_id, any_value(t.n), any_value(t.k), 0.15 / any_value(t.n) + 0.85 * sum(CASE WHEN p.k = 0 THEN p.r / t.n WHEN l.dst_sec_id IS NOT NULL THEN p.r / p.k ELSE 0 END)
 FROM pr p JOIN nn t ON t.doc_id = p.doc_id LEFT JOIN base l ON l.doc_id = p.doc_id AND l.src_sec_id = p.sec_id AND l.dst_sec_id = t.sec_id WHERE p.i < 120 GROUP BY t.doc_id, t.sec_id),
rk AS (SELECT doc_id, sec_id, round(r, 7) AS pagerank FROM pr WHERE i = 120)"""
_ONE = "SELECT sec_key, doc_id, '§' || unnest(regexp_extract_all(text, '{p}', 1)) AS ref FROM sections"
_SINGLE, _INWORD = _ONE.format(p=t.SINGLE), _ONE.format(p=t.INWORD)
_RNG = f"""SELECT sec_key, doc_id, unnest(CASE WHEN split_part(a, '.', 1) = split_part(b, '.', 1) AND split_part(b, '.', 2)::INT - split_part(a, '.', 2)::INT BETWEEN 0 AND 500
 THEN list_transform(generate_series(split_part(a, '.', 2)::INT, split_part(b, '.', 2)::INT), lambda k: '§' || split_part(a, '.', 1) || '.' || k) ELSE ['§' || a, '§' || b] END) AS ref
 FROM (SELECT sec_key, doc_id, unnest(regexp_extract_all(text, '{t.RANGE}', 1)) AS a, unnest(regexp_extract_all(text, '{t.RANGE}', 2)) AS b FROM sections)"""
_TWO = "SELECT sec_key, doc_id, unnest(regexp_extract_all(text, '{p}', 1)) || '{m}' || unnest(regexp_extract_all(text, '{p}', 2)) AS ref FROM sections"
_CROSS = _TWO.format(p=t.CFR_SECTION, m="CFR §") + " UNION ALL " + _TWO.format(p=t.CFR_PART, m="CFR part ")
_COUNT = "SELECT doc_id, ref, count(*) AS n FROM ({}) GROUP BY ALL"
_ALL = f"{_SINGLE} UNION ALL {_INWORD} UNION ALL {_RNG} UNION ALL {_CROSS}"
_SPAN = " UNION ALL ".join(
    f"""SELECT sec_key, {i} AS rank, unnest(m) AS ref_text, unnest(list_transform(generate_series(1, len(m)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))) AS span_start
 FROM (SELECT sec_key, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM sections WHERE text IS NOT NULL)"""
    for i, (_, p) in enumerate(c.SPAN_KINDS)
)
_SPANS = f"""SELECT sec_key, ref_text, span_start::INT AS span_start, (span_start + length(ref_text))::INT AS span_end, ['range', 'local', 'inword', 'cfr_sec', 'cfr_part'][min(rank) + 1] AS kind FROM ({_SPAN}) GROUP BY sec_key, ref_text, span_start"""

_MEMBERS = f"""CASE kind WHEN 'range' THEN (SELECT CASE WHEN split_part(a, '.', 1) = split_part(b, '.', 1) AND TRY_CAST(split_part(b, '.', 2) AS INT) - TRY_CAST(split_part(a, '.', 2) AS INT) BETWEEN 0 AND 500
  THEN list_transform(generate_series(TRY_CAST(split_part(a, '.', 2) AS INT), TRY_CAST(split_part(b, '.', 2) AS INT)), lambda k: '§' || split_part(a, '.', 1) || '.' || k) ELSE ['§' || a, '§' || b] END FROM (SELECT regexp_extract(ref_text, '{t.RANGE}', 1) AS a, regexp_extract(ref_text, '{t.RANGE}', 2) AS b))
 WHEN 'local' THEN list_transform(regexp_extract_all(ref_text, '{t.SINGLE}', 1), lambda x: '§' || x) WHEN 'inword' THEN list_transform(regexp_extract_all(ref_text, '{t.INWORD}', 1), lambda x: '§' || x)
 WHEN 'cfr_sec' THEN [regexp_extract(ref_text, '{t.CFR_SECTION}', 1) || 'CFR §' || regexp_extract(ref_text, '{t.CFR_SECTION}', 2)] ELSE [regexp_extract(ref_text, '{t.CFR_PART}', 1) || 'CFR part ' || regexp_extract(ref_text, '{t.CFR_PART}', 2)] END"""

ORACLE = {
    "flat_refs": f"SELECT sec_key, ref_text, kind, span_start, span_end, unnest({_MEMBERS}) AS norm_token FROM ({_SPANS})",
    "most_cited": f"WITH {BASE_SQL}, {_DEG} SELECT doc_id, rank, sec_id, in_degree, in_span_strength FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY in_span_strength DESC, in_degree DESC, sec_id) AS rank FROM deg) WHERE rank <= 3",
    "refs_single": _COUNT.format(_SINGLE),
    "refs_range": _COUNT.format(_RNG),
    "refs_inword": _COUNT.format(_INWORD),
    "refs_crossdoc": _COUNT.format(_CROSS),
    "refs_normalized": f"SELECT s.sec_key, coalesce(array_to_string(list_sort(list(DISTINCT ref) FILTER (ref IS NOT NULL)), '|'), '') AS refs FROM sections s LEFT JOIN ({_ALL}) a ON a.sec_key = s.sec_key GROUP BY 1",
    "ref_spans": _SPANS,
    "edges_exact": f"""WITH {SECTIONS_SQL}, e AS (SELECT DISTINCT doc_id, sec_id AS src_sec_id, unnest(explicit_refs) AS dst_sec_id FROM xml_refs)
SELECT * FROM e WHERE regexp_matches(dst_sec_id, '^§\\d{{1,3}}\\.\\d{{1,3}}') AND src_sec_id <> dst_sec_id AND EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = e.doc_id AND sec.sec_id = e.src_sec_id) AND EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = e.doc_id AND sec.sec_id = e.dst_sec_id)""",
    "edges_base": f"""WITH x AS (SELECT doc_id, {o.section_id('src_sec_id')} AS src_sec_id, {o.section_id('norm_token')} AS dst_sec_id, match_text, count(*) AS n, min(ref_id) AS f FROM explicit_refs_flat WHERE match_kind IS DISTINCT FROM 'crossdoc' GROUP BY ALL)
SELECT doc_id, src_sec_id, dst_sec_id, sum(n)::BIGINT AS span_count, coalesce(array_to_string((list(match_text ORDER BY f) FILTER (match_text IS NOT NULL))[1:3], '|'), '') AS examples FROM x WHERE doc_id IS NOT NULL AND src_sec_id IS NOT NULL AND dst_sec_id IS NOT NULL GROUP BY 1, 2, 3""",
    "ref_score": f"""WITH {SECTIONS_SQL}, l AS (SELECT doc_id, sec_id, list_distinct(coalesce(flatten(list(explicit_refs) FILTER (explicit_refs IS NOT NULL)), [])) AS l FROM xml_refs GROUP BY 1, 2),
a AS (SELECT sec_key, list(DISTINCT ref) AS r FROM ({_ALL}) GROUP BY 1),
j AS (SELECT l.doc_id, l.sec_id, l, coalesce(r, []) AS r FROM l LEFT JOIN sec ON sec.doc_id = l.doc_id AND sec.sec_id = l.sec_id LEFT JOIN a ON a.sec_key = sec.sec_key),
n AS (SELECT doc_id, sec_id, len(l) AS nl, len(r) AS nr, len(list_intersect(l, r)) AS b FROM j),
p AS (SELECT *, CASE WHEN nr > 0 THEN b / nr WHEN nl = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN nl > 0 THEN b / nl WHEN nr = 0 THEN 1.0 ELSE 0.0 END AS r FROM n)
SELECT doc_id, sec_id, nl AS xml_refs, nr AS pdf_refs, b AS overlap, nl - b AS only_xml, nr - b AS only_pdf, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 1.0 END, 6) AS f1, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1_strict FROM p""",
    "graph_pagerank": f"WITH RECURSIVE {BASE_SQL}, {_NODES}, {_CNT}, {_RANK} SELECT * FROM rk",
    "graph_nodes": f"WITH RECURSIVE {BASE_SQL}, {_NODES}, {_CNT}, {_DEG}, {_RANK} SELECT rk.*, in_degree, out_degree, in_span_strength FROM rk JOIN deg ON deg.doc_id = rk.doc_id AND deg.sec_id = rk.sec_id",
    "graph_degrees": f"WITH {BASE_SQL}, {_DEG} SELECT * FROM deg",
    "in_strength": f"WITH {BASE_SQL}, {_DEG} SELECT doc_id, sec_id, in_span_strength FROM deg",
    "graph_counts_density": f"WITH {BASE_SQL}, {_NODES}, {_CNT} SELECT doc_id, num_nodes, num_edges, round(density, 9) AS density FROM cnt",
    "graph_components": f"WITH RECURSIVE {BASE_SQL}, {_NODES}, {_CMP} SELECT * FROM cmp",
    "graph_clustering": f"WITH {BASE_SQL}, {_NODES}, {_CLU} SELECT doc_id, round(avg_clustering, 9) AS avg_clustering FROM clu",
    "graph_metrics_report": f"WITH RECURSIVE {BASE_SQL}, {_NODES}, {_CNT}, {_CMP}, {_CLU} SELECT cnt.doc_id, num_nodes, num_edges, round(density, 9) AS density, (SELECT count(DISTINCT component) FROM cmp WHERE cmp.doc_id = cnt.doc_id) AS components, round(avg_clustering, 9) AS avg_clustering FROM cnt JOIN clu ON clu.doc_id = cnt.doc_id",
}
