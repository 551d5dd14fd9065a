"""Queries of the operators that compare copies of tables and check references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.keys import section_id
from lexweave.operators.orphans import orphan_citation_counts, orphan_citations
from lexweave.operators.table_diff import table_diff
from lexweave.plans import oracle_parts as o
from lexweave.session import table

PARITY_FIELDS = ["xml_len", "pdf_len", "len_ratio", "xml_tokens", "pdf_tokens", "jaccard_unigram", "rf_similarity", "xml_heading", "pdf_heading"]
PARITY_SCALES = {"len_ratio": 3, "jaccard_unigram": 3, "rf_similarity": 1}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    def side(name: str) -> DataFrame:
        df = table(spark, d, name)
        return df.withColumn("sec_id", F.coalesce(section_id(F.col("sec_id")), F.col("sec_id")))

    return table_diff(side("parity_report"), side("parity_report_mirror"), ["doc_id", "sec_id"], "loaded_at", PARITY_SCALES, PARITY_FIELDS)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("field_name").agg(F.count("*").alias("sections"), F.countDistinct("doc_id").alias("regulations"))


def _references(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("explicit_refs_flat", "sections", "cited_titles")]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_citations(*_references(spark, d)).select("ref_id", "field_name")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_citation_counts(*_references(spark, d))


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p7_counts": p7_counts}


def _p6_sql() -> str:
    def side(name: str) -> str:
        key = f"coalesce({o.section_id('sec_id')}, sec_id)"
        cols = ["xml_len", "pdf_len", "xml_tokens", "pdf_tokens", "xml_heading", "pdf_heading"]
        nums = ", ".join(f"round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, {n}) AS {c}" for c, n in PARITY_SCALES.items())
        return f"(SELECT * FROM (SELECT doc_id, {key} AS sec_id, {', '.join(cols)}, {nums}, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY loaded_at DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in PARITY_FIELDS)}) AS rn FROM {name}) WHERE rn = 1)"

    parts = [f"SELECT a.doc_id, a.sec_id, '{f}' AS field_name FROM a JOIN b ON a.doc_id = b.doc_id AND a.sec_id = b.sec_id WHERE a.{f} IS DISTINCT FROM b.{f}" for f in PARITY_FIELDS]
    for x, y, n in (("a", "b", "left_only"), ("b", "a", "right_only")):
        parts.append(f"SELECT doc_id, sec_id, '{n}' AS field_name FROM {x} WHERE NOT EXISTS (SELECT 1 FROM {y} WHERE {y}.doc_id = {x}.doc_id AND {y}.sec_id = {x}.sec_id)")
    return f"WITH a AS {side('parity_report')}, b AS {side('parity_report_mirror')} " + " UNION ALL ".join(parts)


def _p7_sql() -> str:
    return f"""
WITH e AS (
  SELECT ref_id, 'src_sec_id' AS field_name, 'sections' AS target_table, doc_id, {o.section_id('src_sec_id')} AS k, seen_at FROM explicit_refs_flat
  UNION ALL
  SELECT ref_id, 'norm_token', 'sections', doc_id, {o.section_id('norm_token')}, seen_at FROM explicit_refs_flat WHERE match_kind IS DISTINCT FROM 'crossdoc'
  UNION ALL
  SELECT ref_id, 'norm_token', 'cited_titles', '', {o.cited_title('norm_token')}, seen_at FROM explicit_refs_flat WHERE match_kind = 'crossdoc'
), t AS (
  SELECT 'sections' AS target_table, doc_id, {o.section_id('sec_id')} AS k, loaded_at AS f, removed_at AS u FROM sections
  UNION ALL SELECT 'cited_titles', '', token, listed_from, listed_until FROM cited_titles
), lost AS (
  SELECT e.* FROM e WHERE k IS NOT NULL AND seen_at IS NOT NULL AND doc_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM t WHERE t.target_table = e.target_table AND t.doc_id = e.doc_id AND t.k = e.k AND t.f <= e.seen_at AND (t.u IS NULL OR t.u > e.seen_at)))
"""


ORACLE = {
    "p6_found": _p6_sql(),
    "p6_counts": f"SELECT field_name, count(*) AS sections, count(DISTINCT doc_id) AS regulations FROM ({_p6_sql()}) GROUP BY field_name",
    "p7_found": _p7_sql() + "SELECT ref_id, field_name FROM lost",
    "p7_counts": _p7_sql() + "SELECT field_name, target_table, strftime(seen_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT doc_id || '|' || k) AS targets FROM lost GROUP BY ALL",
}
