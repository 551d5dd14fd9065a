"""Queries of gists, plans, summaries and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators import evaluate as ev
from lexweave.operators import gists as gs
from lexweave.operators import graph as g
from lexweave.operators import stitch as st
from lexweave.operators.vectors import cosine
from lexweave.plans import ranking_queries as rq
from lexweave.plans.citation_graph import SECTIONS_SQL, canonical_sections, whole_documents_with
from lexweave.session import stored, table


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = canonical_sections(spark, d)
    return s.select("doc_id", "sec_id", F.posexplode(gs.gist_sentences(F.col("text"))).alias("sent_idx", "sent_text"))


def _gists(p: rq.Pipeline) -> DataFrame:
    near = gs.windows(p.waypoints, p.profile.select("doc_id", "sec_id", "pos"))
    return gs.gists_of(whole_documents_with(p.spark, p.d, near, ["pos", "anchor"]))


def gists(spark: SparkSession, d: str) -> DataFrame:
    return _gists(rq.Pipeline(spark, d))


def _plan(p: rq.Pipeline) -> DataFrame:
    return st.stitch_plan(p.waypoints.select("doc_id", "sec_id", "rank"), p.merged, g.centrality(p.merged, p.profile))


def plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(rq.Pipeline(spark, d))


def _given_gists(spark: SparkSession, d: str) -> DataFrame:
    """One gist per anchor of the gists table: the last one written."""
    x = table(spark, d, "gists").filter("gist_text <> ''").groupBy("doc_id", "anchor_sec_id").agg(F.max(F.struct("gist_id", "gist_text")).alias("b"))
    return x.select("doc_id", "anchor_sec_id", "b.gist_text")


def given_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan of every section, in order: the input of rendering that needs no ranking."""
    return rq.numbered(canonical_sections(spark, d))


def rendered(spark: SparkSession, d: str) -> DataFrame:
    p = rq.Pipeline(spark, d)
    return st.render(p.positions, p.sections, _given_gists(spark, d), 1200)


def full_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """From sections to summaries: rank, pick sentences, stitch, render."""
    p = rq.Pipeline(spark, d)
    return st.render_leads(stored(_plan(p)), p.leads, stored(_gists(p).select("doc_id", "anchor_sec_id", "gist_text")), 1200)


def deliverables(spark: SparkSession, d: str) -> DataFrame:
    p = rq.Pipeline(spark, d)
    steps = stored(_plan(p))
    return st.deliverable(steps, st.render_leads(steps, p.leads, _given_gists(spark, d), 1200).select("doc_id", "summary_text"))


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "summary_eval_3000").select("eval_id", F.col("doc").alias("doc_id"), "summary_text", "status", "path")


def eval_words_cues(spark: SparkSession, d: str) -> DataFrame:
    n, k = ev.words(F.col("summary_text")), ev.cue_count(F.col("summary_text"))
    return _summaries(spark, d).select("eval_id", n.alias("words"), k.alias("cue_count"), F.round(100 * k / F.greatest(F.lit(1), n), 2).alias("cue_density"))


def eval_coverage(spark: SparkSession, d: str) -> DataFrame:
    one = _summaries(spark, d).groupBy("doc_id").agg(F.max(F.struct("eval_id", "summary_text")).alias("b")).select("doc_id", "b.summary_text")
    out = ev.coverage(given_plan(spark, d), one)
    return out.select("doc_id", F.round("coverage", 6).alias("coverage"), F.round("coverage_strict", 6).alias("coverage_strict"))


def eval_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    ref = _given_gists(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("anchor_sec_id", "gist_text"))), lambda x: x["gist_text"]), "\n").alias("ref"))
    j = _summaries(spark, d).join(ref, "doc_id", "left")
    return ev.with_rouge_l(j, "ref", "summary_text").select("eval_id", F.round("rouge_l", 6).alias("rouge_l"))


def eval_embed_sim(spark: SparkSession, d: str) -> DataFrame:
    """Mean similarity of each label's first vector (the summary) with all its vectors (the gists)."""
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("s"))
    return e.join(first, "label").groupBy("label").agg(F.round(F.avg(cosine(F.col("embedding"), F.col("s"))), 4).alias("embed_sim"))


def eval_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of every summary, and a MISSING row for every regulation that has none."""
    docs = table(spark, d, "sections").select("doc_id").dropna().distinct()
    j = docs.join(_summaries(spark, d), "doc_id", "full_outer")
    return j.select("doc_id", "eval_id", F.when(F.coalesce("summary_text", F.lit("")) == "", "MISSING").otherwise(F.coalesce("status", F.lit("OK"))).alias("status"))


def _column(name: str, f) -> object:
    return lambda s, d: _summaries(s, d).select("eval_id", f(F.col("summary_text")).alias(name))


QUERIES = {
    "sentence_split": sentence_split,
    "gists_mmr": lambda s, d: gists(s, d).select("doc_id", "anchor_sec_id", "gist_text", "token_estimate", F.size("source_spans").alias("sentences")),
    "stitch_plan": plan,
    "render_budget": rendered,
    "full_pipeline": full_pipeline,
    "deliverable": deliverables,
    "mojibake_fix": _column("fixed", t.fix_garbled),
    "citation_spacing": _column("spaced", t.citation_spacing),
    "word_cap": _column("capped", lambda c: t.word_cap(c, 60)),
    "refine_none": _column("refined", lambda c: st.refine(c, 60)),
    "refine_context": lambda s, d: st.refine_context(given_plan(s, d), canonical_sections(s, d), _given_gists(s, d)),
    "eval_words_cues": eval_words_cues,
    "eval_coverage": eval_coverage,
    "eval_redundancy": lambda s, d: _summaries(s, d).select("eval_id", F.round(ev.trigram_redundancy(F.col("summary_text")), 6).alias("redundancy")),
    "eval_mojibake": lambda s, d: _summaries(s, d).select("eval_id", F.when(ev.mojibake_flag(F.col("summary_text")), "YES").otherwise("no").alias("mojibake")),
    "eval_status": eval_status,
    "eval_rouge_l": eval_rouge_l,
    "eval_embed_sim": eval_embed_sim,
}

_S = "summary_text"
_W = f"list_filter(string_split(trim(regexp_replace(coalesce({_S}, ''), '{t.WS}+', ' ', 'g')), ' '), lambda x: x <> '')"
_NB = "[\\s\\x{00A0}\\x{2009}\\x{202F}]"
_PLACED = "pl AS (SELECT doc_id, sec_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sec_key) - 1 AS pos FROM sec)"


def _fix_sql(c: str) -> str:
    for bad, good in t.GARBLED:
        bad = bad.replace("\x9d", "' || chr(157) || '").replace("\x9c", "' || chr(156) || '")
        c = f"replace({c}, '{bad}', '{good}')"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), '\\s+\\n', chr(10), 'g'), '\\n\\s+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_GIVEN = "gi AS (SELECT doc_id, anchor_sec_id, arg_max(gist_text, gist_id) AS gist_text FROM gists WHERE gist_text <> '' GROUP BY ALL)"
_LEAD = f"array_to_string(string_split(coalesce(text, ''), '. ')[1:2], '. ')"
_FOLD = f"""bl AS (SELECT pl.doc_id, pl.pos, pl.sec_id, coalesce(sec.heading, '') AS heading, CASE WHEN coalesce(gist_text, '') <> '' THEN gist_text WHEN regexp_replace({_LEAD}, '^{t.WS}+|{t.WS}+$', '', 'g') = '' THEN '' ELSE regexp_replace({_LEAD}, '\\.+$', '') || '.' END AS summary_text
 FROM pl JOIN sec ON sec.doc_id = pl.doc_id AND sec.sec_id = pl.sec_id LEFT JOIN gi ON gi.doc_id = pl.doc_id AND gi.anchor_sec_id = pl.sec_id),
ib AS (SELECT *, greatest(1, len({_W})) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM bl WHERE summary_text <> ''),
fo AS (SELECT doc_id, rn, n <= 1200 AS ok, CASE WHEN n <= 1200 THEN n ELSE 0 END AS total FROM ib WHERE rn = 1
 UNION ALL SELECT ib.doc_id, ib.rn, fo.total + ib.n <= 1200, CASE WHEN fo.total + ib.n <= 1200 THEN fo.total + ib.n ELSE fo.total END FROM fo JOIN ib ON ib.doc_id = fo.doc_id AND ib.rn = fo.rn + 1),
rendered AS (SELECT fo.doc_id, coalesce(string_agg(ib.sec_id || ' — ' || ib.heading || chr(10) || ib.summary_text || chr(10), chr(10) ORDER BY ib.pos) FILTER (ok), '') || chr(10) || '[approx tokens used: ' || max(total) || ']' AS summary_text, max(total) AS words, count(*) FILTER (ok) AS blocks
 FROM fo JOIN ib ON ib.doc_id = fo.doc_id AND ib.rn = fo.rn GROUP BY 1)"""
_CAP = f"""CASE WHEN n <= 60 THEN {_S} WHEN e <> '' AND length(c) - length(e) <= 40 THEN e ELSE c END"""
ORACLE = {
    "sentence_split": f"""WITH {SECTIONS_SQL}, q AS (SELECT doc_id, sec_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.?!;:]){t.WS}+([A-Z(§])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^{t.WS}+|{t.WS}+$', '', 'g')), lambda x: length(x) >= 2 AND len(list_filter(string_split(trim(regexp_replace(x, '{t.WS}+', ' ', 'g')), ' '), lambda y: y <> '')) >= 3) AS l FROM sec)
SELECT doc_id, sec_id, (unnest(generate_series(1, len(l))) - 1)::INT AS sent_idx, unnest(l) AS sent_text FROM q""",
    "citation_spacing": f"SELECT eval_id, regexp_replace(regexp_replace({_S}, '\\({t.WS}*§{t.WS}*', '(§', 'g'), '{t.WS}+\\)', ')', 'g') AS spaced FROM summary_eval_3000",
    "mojibake_fix": f"SELECT eval_id, {_fix_sql(_S)} AS fixed FROM summary_eval_3000",
    "word_cap": f"SELECT eval_id, {_CAP} AS capped FROM (SELECT eval_id, {_S}, n, c, regexp_extract(c, '(?s)^(.+[.!?])[^.!?]*$', 1) AS e FROM (SELECT eval_id, {_S}, len({_W}) AS n, array_to_string({_W}[1:60], ' ') AS c FROM summary_eval_3000))",
    "eval_words_cues": f"SELECT eval_id, len({_W}) AS words, len(regexp_extract_all(coalesce({_S}, ''), '{t.SECTION_CUE}')) AS cue_count, round(100 * len(regexp_extract_all(coalesce({_S}, ''), '{t.SECTION_CUE}')) / greatest(1, len({_W})), 2) AS cue_density FROM summary_eval_3000",
    "eval_coverage": f"""WITH {SECTIONS_SQL}, s AS (SELECT doc AS doc_id, regexp_replace(coalesce(summary_text, ''), '{t.WS}+', '', 'g') AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY eval_id DESC) AS rn FROM summary_eval_3000) WHERE rn = 1)
SELECT sec.doc_id, round(avg(contains(s, sec_id)::INT) * 100, 6) AS coverage, round(avg(regexp_matches(s, replace(sec_id, '.', '\\.') || '([^0-9]|$)')::INT) * 100, 6) AS coverage_strict FROM sec JOIN s ON s.doc_id = sec.doc_id GROUP BY 1""",
    "eval_redundancy": f"WITH w AS (SELECT eval_id, {_W} AS w FROM summary_eval_3000), r AS (SELECT eval_id, w, list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) AS r FROM w) SELECT eval_id, CASE WHEN len(w) < 3 THEN 0.0 ELSE round(1 - len(list_distinct(r)) / len(r), 6) END AS redundancy FROM r",
    "eval_mojibake": f"SELECT eval_id, CASE WHEN contains(coalesce({_S}, ''), 'Â§') OR contains(coalesce({_S}, ''), 'â€') THEN 'YES' ELSE 'no' END AS mojibake FROM summary_eval_3000",
    "eval_status": f"SELECT coalesce(s.doc_id, e.doc) AS doc_id, eval_id, CASE WHEN coalesce({_S}, '') = '' THEN 'MISSING' ELSE coalesce(status, 'OK') END AS status FROM (SELECT DISTINCT doc_id FROM sections WHERE doc_id IS NOT NULL) s FULL JOIN summary_eval_3000 e ON e.doc = s.doc_id",
    "refine_none": f"SELECT eval_id, {_CAP} AS refined FROM (SELECT eval_id, {_S}, n, c, regexp_extract(c, '(?s)^(.+[.!?])[^.!?]*$', 1) AS e FROM (SELECT eval_id, {_S}, len({_W}) AS n, array_to_string({_W}[1:60], ' ') AS c FROM (SELECT eval_id, regexp_replace(regexp_replace({_fix_sql(_S)}, '\\({t.WS}*§{t.WS}*', '(§', 'g'), '{t.WS}+\\)', ')', 'g') AS {_S} FROM summary_eval_3000)))",
    "render_budget": f"WITH RECURSIVE {SECTIONS_SQL}, {_PLACED}, {_GIVEN}, {_FOLD} SELECT * FROM rendered",
    "refine_context": f"""WITH {SECTIONS_SQL}, {_PLACED}, {_GIVEN}, own AS (SELECT * FROM (SELECT pl.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM pl WHERE starts_with(sec_id, '§' || regexp_extract(doc_id, '_([0-9]+)$', 1) || '.')) WHERE rn <= 18)
SELECT own.doc_id, string_agg(own.sec_id || ' — ' || coalesce(sec.heading, '') || chr(10) || coalesce(gi.gist_text, ''), chr(10) || chr(10) ORDER BY own.pos) AS context FROM own LEFT JOIN sec ON sec.doc_id = own.doc_id AND sec.sec_id = own.sec_id LEFT JOIN gi ON gi.doc_id = own.doc_id AND gi.anchor_sec_id = own.sec_id GROUP BY 1""",
    "eval_embed_sim": "SELECT e.label, round(avg(list_dot_product(e.embedding::DOUBLE[], f.s::DOUBLE[])), 4) AS embed_sim FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS s FROM embeddings GROUP BY 1) f ON f.label = e.label GROUP BY 1",
    "stitch_plan": rq.ORACLE["edges_merged"].split(" SELECT doc_id, src_sec_id, dst_sec_id, edge_type, round(score")[0]
    + f", way AS (SELECT * FROM ({rq.ORACLE['waypoints']})), "
    + """cen AS (SELECT doc_id, sec_id, i / greatest(1e-9, max(i) OVER (PARTITION BY doc_id)) AS c FROM (SELECT sec.doc_id, sec.sec_id, coalesce(i.w, 0) AS i FROM sec LEFT JOIN (SELECT doc_id, dst_sec_id, sum(weight) AS w FROM mer GROUP BY ALL) i ON i.doc_id = sec.doc_id AND i.dst_sec_id = sec.sec_id)),
nb AS (SELECT way.doc_id, way.rank AS a, mer.dst_sec_id AS sec_id, row_number() OVER (PARTITION BY way.doc_id, way.sec_id ORDER BY round(mer.weight + 0.25 * coalesce(cen.c, 0), 9) DESC, mer.dst_sec_id) AS b FROM way JOIN mer ON mer.doc_id = way.doc_id AND mer.src_sec_id = way.sec_id LEFT JOIN cen ON cen.doc_id = mer.doc_id AND cen.sec_id = mer.dst_sec_id),
it AS (SELECT doc_id, rank AS a, 0 AS b, sec_id FROM way UNION ALL SELECT doc_id, a, b, sec_id FROM nb WHERE b <= 3),
fi AS (SELECT doc_id, sec_id, min(struct_pack(a := a, b := b)) AS p FROM it GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, sec_id, CASE WHEN p.b = 0 THEN 'anchor' ELSE 'neighbor' END AS role FROM fi""",
}
