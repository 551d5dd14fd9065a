"""Queries of structuring and comparison.

The sections table holds some sections twice (parsed again later): the first and the last parse of a section are the
two versions that are compared, and parity_report and its mirror are the two candidate parses that are scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.functions.keys import section_id
from lexweave.operators import compare as cmp
from lexweave.operators import structure as st
from lexweave.operators.graph import top_k
from lexweave.plans import oracle_parts as o
from lexweave.plans.citation_graph import SECTIONS_SQL, canonical_sections
from lexweave.session import table

def _sections(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").withColumn("sec_id", section_id(F.col("sec_id")))
    return s.filter("sec_id IS NOT NULL AND doc_id IS NOT NULL").select("sec_key", "doc_id", "sec_id", "idx", "label", "heading", "text", "tokens", "loaded_at")


def last_parse(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d).groupBy("doc_id", "sec_id").agg(F.max(F.struct("loaded_at", "sec_key", "heading", "text")).alias("b"))
    return s.select("doc_id", "sec_id", "b.heading", "b.text")


def section_filter_part(spark: SparkSession, d: str) -> DataFrame:
    return st.filter_by_part(table(spark, d, "sections"), F.regexp_extract("doc_id", r"_([0-9]+)$", 1)).groupBy("doc_id").agg(F.count("*").alias("sections"))


def section_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return st.dedupe_first(_sections(spark, d), ["idx", "sec_key"]).select("doc_id", "sec_id", "sec_key", "idx")


def section_dedupe_longest(spark: SparkSession, d: str) -> DataFrame:
    return st.dedupe_longest(_sections(spark, d), ["sec_key"]).select("doc_id", "sec_id", "sec_key", "idx", F.length("text").alias("chars"))


def reserved_range_expand(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct range citation taken as the number of a reserved section."""
    ranges = table(spark, d, "explicit_refs_flat").filter("match_kind = 'range'").select("doc_id", "match_text").distinct()
    return ranges.select("doc_id", "match_text", F.explode(st.reserved_ids(F.col("match_text"), F.lit("[Reserved]"))).alias("sec_id"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each document written out as lines: a header line, then the text's lines."""
    s = canonical_sections(spark, d)
    head = F.concat_ws(" ", F.regexp_replace("sec_id", "^§", "§ "), F.col("heading"))
    lines = s.select("doc_id", "idx", "sec_key", F.posexplode(F.concat(F.array(head), F.split(F.coalesce("text", F.lit("")), "\n"))).alias("k", "line"))
    return lines.select("doc_id", F.format_string("%08d.%012d.%06d", "idx", "sec_key", "k").alias("line_no"), "line")


def line_clean_segment(spark: SparkSession, d: str) -> DataFrame:
    return st.segment_lines(st.clean_lines(page_lines(spark, d))).select("doc_id", "idx", "sec_id", "heading", F.md5("text").alias("text_md5"), "tokens")


def dehyphenate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines broken after every hyphen and joined again."""
    broken = page_lines(spark, d).select("doc_id", "line_no", F.posexplode(F.split("line", r"(?<=[A-Za-z]-)(?=[A-Za-z])")).alias("k", "line"))
    broken = broken.select("doc_id", F.format_string("%s.%06d", "line_no", "k").alias("line_no"), "line")
    return st.dehyphenate_lines(broken).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def merged_headers(spark: SparkSession, d: str) -> DataFrame:
    return st.merge_wrapped_headers(st.clean_lines(page_lines(spark, d))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def _reported(spark: SparkSession, d: str, name: str) -> DataFrame:
    r = table(spark, d, name).withColumn("sec_id", section_id(F.col("sec_id"))).filter("sec_id IS NOT NULL AND doc_id IS NOT NULL")
    return r.groupBy("doc_id", "sec_id").agg(F.max(F.struct("loaded_at", "pdf_len")).alias("b")).select("doc_id", "sec_id", F.coalesce("b.pdf_len", F.lit(0)).alias("size"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return canonical_sections(spark, d).select("doc_id", "sec_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))


def align_semi(spark: SparkSession, d: str) -> DataFrame:
    return st.keep_known(_reported(spark, d, "parity_report_mirror"), canonical_sections(spark, d)).select("doc_id", "sec_id")


def align_anti_fill(spark: SparkSession, d: str) -> DataFrame:
    """The candidate has only sections that cite something, so it lacks the reserved ones."""
    cites = table(spark, d, "explicit_refs_flat").select("doc_id", section_id(F.col("src_sec_id")).alias("sec_id"))
    return st.reserved_missing(canonical_sections(spark, d), cites).select("doc_id", "sec_id", "heading", "tokens")


def alignment_score(spark: SparkSession, d: str) -> DataFrame:
    return st.alignment_score(_sizes(spark, d), _reported(spark, d, "parity_report"))


def backend_winner(spark: SparkSession, d: str) -> DataFrame:
    """Which of the two reports covers each regulation better; of equal ones the one with fewer rows to read, which stand for runtime."""
    scored = None
    for name in ("parity_report", "parity_report_mirror"):
        rows = table(spark, d, name).groupBy("doc_id").agg(F.count("*").cast("double").alias("runtime_s"))
        s = st.alignment_score(_sizes(spark, d), _reported(spark, d, name)).join(rows, "doc_id", "left").select("doc_id", "f1", F.lit(name).alias("backend"), F.lit(False).alias("preferred"), "runtime_s")
        scored = s if scored is None else scored.unionByName(s)
    return st.best_candidate(scored)


def parity(spark: SparkSession, d: str) -> DataFrame:
    return cmp.compare_sections(canonical_sections(spark, d).select("doc_id", "sec_id", "heading", "text"), last_parse(spark, d))


def parity_diff(spark: SparkSession, d: str) -> DataFrame:
    a = canonical_sections(spark, d).select("doc_id", "sec_id", F.col("text").alias("a"))
    j = a.join(last_parse(spark, d).select("doc_id", "sec_id", F.col("text").alias("b")), ["doc_id", "sec_id"]).filter("NOT a <=> b")
    return cmp.unified_diffs(j, "a", "b").select("doc_id", "sec_id", "diff")


def parity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sections per regulation that are common, only in sections, only in the report, and the first 25 of those missing."""
    counts = alignment_score(spark, d).select("doc_id", F.col("overlap").alias("common"), F.col("only_left").alias("missing"), F.col("only_right").alias("extra"))
    lost = cmp.missing(canonical_sections(spark, d), _reported(spark, d, "parity_report")).filter("side = 'left_only'")
    first = top_k(lost, ["doc_id"], [F.col("sec_id")], 25).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("sec_id")), " ").alias("missing_ids"))
    return counts.join(first, "doc_id", "left").fillna("", ["missing_ids"])


def parity_worst(spark: SparkSession, d: str) -> DataFrame:
    """Of the newest row of every section."""
    r = table(spark, d, "parity_report").withColumn("sec_id", section_id(F.col("sec_id"))).filter("sec_id IS NOT NULL AND doc_id IS NOT NULL")
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    newest = r.select("doc_id", "sec_id", "loaded_at", number("rf_similarity"), number("len_ratio")).groupBy("doc_id", "sec_id").agg(F.max(F.struct("loaded_at", "rf_similarity", "len_ratio")).alias("b"))
    return cmp.worst(newest.select("doc_id", "sec_id", "b.rf_similarity", "b.len_ratio"))


def xml_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every row of sections written as markup, with nested levels, and parsed again."""
    s = table(spark, d, "sections")
    safe = lambda c: F.regexp_replace(F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), "\r", "&#13;")
    subpart = F.concat(F.lit('<DIV6 TYPE="SUBPART"><HEAD>Subpart '), safe(F.get("hierarchy_path", F.lit(0))), F.lit("</HEAD>"))
    node = F.concat(F.lit('<DIV8 N="1" TYPE="SECTION"><SECTNO>'), safe(F.col("sec_id")), F.lit("</SECTNO><DIV9><SUBJECT>"), safe(F.col("heading")), F.lit("</SUBJECT></DIV9><P>"), safe(F.col("text")), F.lit("</P></DIV8>"))
    inside = F.when(F.get("hierarchy_path", F.lit(0)).isNotNull(), F.concat(subpart, node, F.lit("</DIV6>"))).otherwise(node)
    xml = s.select(F.col("sec_key").cast("string").alias("doc_id"), F.concat(F.lit("<DIV5><SECTION>no type</SECTION>"), inside, F.lit("</DIV5>")).alias("xml"))
    out = st.parse_xml(xml)
    return out.select(F.col("doc_id").cast("bigint").alias("sec_key"), "sec_id", "label", "heading", F.md5("text").alias("text_md5"), F.array_join("hierarchy_path", "|").alias("path"), "tokens")


QUERIES = {
    "section_filter_part": section_filter_part,
    "section_dedupe_first": section_dedupe_first,
    "section_dedupe_longest": section_dedupe_longest,
    "reserved_range_expand": reserved_range_expand,
    "line_clean_segment": line_clean_segment,
    "dehyphenate_lines": dehyphenate_lines,
    "merge_wrapped_headers": merged_headers,
    "align_semi": align_semi,
    "align_anti_fill": align_anti_fill,
    "alignment_score": alignment_score,
    "backend_winner": backend_winner,
    "parity_report_built": parity,
    "parity_measures": lambda s, d: parity(s, d).drop("rf_similarity"),
    "parity_worst": parity_worst,
    "xml_parse": xml_parse,
    "parity_missing": lambda s, d: cmp.missing(canonical_sections(s, d), _reported(s, d, "parity_report_mirror")),
    "parity_diff": parity_diff,
    "parity_summary": parity_summary,
}

_KEY = o.section_id("sec_id")
_REP = lambda n: f"(SELECT doc_id, sec_id, size FROM (SELECT doc_id, {_KEY} AS sec_id, coalesce(pdf_len, 0) AS size, row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY loaded_at DESC NULLS LAST, pdf_len DESC NULLS LAST) AS rn FROM {n}) WHERE rn = 1 AND sec_id IS NOT NULL AND doc_id IS NOT NULL)"
_LINES = """lin AS (SELECT doc_id, format('{:08d}.{:012d}.{:06d}', idx, sec_key, k - 1) AS line_no, l[k] AS line FROM (SELECT doc_id, idx, sec_key, l, unnest(generate_series(1, len(l))) AS k FROM (SELECT doc_id, idx, sec_key, list_concat([concat_ws(' ', regexp_replace(sec_id, '^§', '§ '), heading)], string_split(coalesce(text, ''), chr(10))) AS l FROM sec)))"""
_SQ = lambda c: f"trim(regexp_replace({c}, '{t.WS}+', ' ', 'g'))"
_CLEAN = f"cl AS (SELECT doc_id, line_no, {_SQ('line')} AS line FROM lin WHERE {_SQ('line')} <> '' AND NOT regexp_matches({_SQ('line')}, '{t.PAGE_JUNK}'))"
_TOK = lambda c: f"greatest(1, len(list_filter(string_split({_SQ(c)}, ' '), lambda x: x <> '')))"
_UNI = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^A-Za-z0-9_§.]+', ' ', 'g')), ' '), lambda w: w <> ''))"
_LABEL = r"(\d{1,3}\.\d{1,3}[A-Za-z0-9\-]*(?:\([a-z0-9]+\))?)"
_SPACES = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g'), chr(13), ''), '([A-Za-z0-9_])-\\n([A-Za-z0-9_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'), '^{t.WS}+|{t.WS}+$', '', 'g')"
_ALIGN = lambda n: f"""SELECT doc_id, overlap, only_left, only_right, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(q[len(q) // 2 + 1], 6) AS ratio_median, round(q[(3 * len(q)) // 4 + 1] - q[len(q) // 4 + 1], 6) AS ratio_iqr FROM (
 SELECT *, CASE WHEN overlap + only_right > 0 THEN overlap / (overlap + only_right) ELSE 0 END AS p, CASE WHEN overlap + only_left > 0 THEN overlap / (overlap + only_left) ELSE 0 END AS r FROM (
 SELECT doc_id, sum((a IS NOT NULL AND b IS NOT NULL)::INT) AS overlap, sum((b IS NULL)::INT) AS only_left, sum((a IS NULL)::INT) AS only_right, list_sort(list(b / greatest(1, a)) FILTER (a IS NOT NULL AND b IS NOT NULL)) AS q FROM (
 SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x.size AS a, y.size AS b FROM (SELECT doc_id, sec_id, coalesce(length(text), 0) AS size FROM sec) x FULL JOIN {_REP(n)} y ON x.doc_id = y.doc_id AND x.sec_id = y.sec_id) GROUP BY 1))"""  # noqa: E731

ORACLE = {
    "section_filter_part": f"SELECT doc_id, count(*) AS sections FROM sections WHERE regexp_extract(label, '§{t.WS}*([0-9]+)', 1) = regexp_extract(doc_id, '_([0-9]+)$', 1) GROUP BY 1",
    "section_dedupe_first": f"WITH {SECTIONS_SQL} SELECT doc_id, sec_id, sec_key, idx FROM sec",
    "section_dedupe_longest": f"SELECT doc_id, sec_id, sec_key, idx, chars FROM (SELECT doc_id, {_KEY} AS sec_id, sec_key, length(text) AS chars, min(idx) OVER (PARTITION BY doc_id, {_KEY}) AS idx, row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY coalesce(length(text), 0) DESC, sec_key) AS rn FROM sections WHERE {_KEY} IS NOT NULL AND doc_id IS NOT NULL) WHERE rn = 1",
    "reserved_range_expand": f"""SELECT doc_id, match_text, unnest(list_transform(generate_series(m, n), lambda k: '§' || p || '.' || k)) AS sec_id FROM (
 SELECT DISTINCT doc_id, match_text, regexp_extract(match_text, '([0-9]{{1,3}})\\.([0-9]{{1,3}}){t.WS}*[–-]{t.WS}*([0-9]{{1,3}})\\.([0-9]{{1,3}})', 1) AS p, regexp_extract(match_text, '([0-9]{{1,3}})\\.([0-9]{{1,3}}){t.WS}*[–-]{t.WS}*([0-9]{{1,3}})\\.([0-9]{{1,3}})', 3) AS q,
 TRY_CAST(regexp_extract(match_text, '([0-9]{{1,3}})\\.([0-9]{{1,3}}){t.WS}*[–-]{t.WS}*([0-9]{{1,3}})\\.([0-9]{{1,3}})', 2) AS INT) AS m, TRY_CAST(regexp_extract(match_text, '([0-9]{{1,3}})\\.([0-9]{{1,3}}){t.WS}*[–-]{t.WS}*([0-9]{{1,3}})\\.([0-9]{{1,3}})', 4) AS INT) AS n FROM explicit_refs_flat WHERE match_kind = 'range') WHERE p <> '' AND p = q AND n - m BETWEEN 0 AND 500 AND starts_with(regexp_replace(match_text, '^{t.WS}+', ''), '§§')""",
    "line_clean_segment": f"""WITH {SECTIONS_SQL}, {_LINES}, {_CLEAN}, sg AS (SELECT *, regexp_matches(line, '{t.HEADER_LINE}') AS h, sum(regexp_matches(line, '{t.HEADER_LINE}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS idx FROM cl),
 g AS (SELECT doc_id, idx, max(line) FILTER (h) AS head, {_SQ("coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT h AND NOT regexp_matches(line, '" + t.NOISE_LINE + "')), '')")} AS text FROM sg WHERE idx > 0 GROUP BY ALL)
SELECT doc_id, idx, '§' || regexp_extract(head, '{t.HEADER_LINE}', 1) AS sec_id, trim(regexp_extract(head, '{t.HEADER_LINE}', 2)) AS heading, md5(text) AS text_md5, {_TOK('text')} AS tokens FROM g""",
    "align_semi": f"WITH {SECTIONS_SQL} SELECT y.doc_id, y.sec_id FROM {_REP('parity_report_mirror')} y WHERE EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = y.doc_id AND sec.sec_id = y.sec_id)",
    "align_anti_fill": f"""WITH {SECTIONS_SQL} SELECT doc_id, sec_id, CASE WHEN coalesce(heading, '') = '' THEN '[Reserved]' ELSE heading END AS heading, 1 AS tokens FROM sec WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, {o.section_id('src_sec_id')} AS sec_id FROM explicit_refs_flat) y WHERE y.doc_id = sec.doc_id AND y.sec_id = sec.sec_id)
 AND (starts_with(lower(trim(coalesce(heading, ''))), '[reserved') OR (length({_SQ("coalesce(text, '')")}) <= 60 AND contains(lower(coalesce(text, '')), 'reserved')) OR regexp_replace(lower(coalesce(text, '')), '[\\s\\[\\]\\.\\-–—]+', '', 'g') IN ('reserved', 'reserved;', 'reserved:'))""",
    "alignment_score": f"WITH {SECTIONS_SQL} {_ALIGN('parity_report')}",
    "parity_summary": f"WITH {SECTIONS_SQL} SELECT doc_id, overlap AS common, only_left AS missing, only_right AS extra, coalesce(ids, '') AS missing_ids FROM ({_ALIGN('parity_report')}) a LEFT JOIN (SELECT doc_id AS d, array_to_string(list_sort(list(sec_id))[1:25], ' ') AS ids FROM sec WHERE NOT EXISTS (SELECT 1 FROM {_REP('parity_report')} y WHERE y.doc_id = sec.doc_id AND y.sec_id = sec.sec_id) GROUP BY 1) m ON m.d = a.doc_id",
    "backend_winner": f"WITH {SECTIONS_SQL} SELECT doc_id, backend, f1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f1 DESC, coalesce(n, 1e9), backend) AS rn FROM (SELECT a.doc_id, f1, 'parity_report' AS backend, n FROM ({_ALIGN('parity_report')}) a LEFT JOIN (SELECT doc_id, count(*) AS n FROM parity_report GROUP BY 1) r ON r.doc_id = a.doc_id UNION ALL SELECT a.doc_id, f1, 'parity_report_mirror', n FROM ({_ALIGN('parity_report_mirror')}) a LEFT JOIN (SELECT doc_id, count(*) AS n FROM parity_report_mirror GROUP BY 1) r ON r.doc_id = a.doc_id)) WHERE rn = 1",
    "parity_worst": f"""WITH v AS (SELECT doc_id, {_KEY} AS sec_id, loaded_at, CASE WHEN NOT isnan(rf_similarity) THEN rf_similarity END AS rf_similarity, CASE WHEN NOT isnan(len_ratio) THEN len_ratio END AS len_ratio FROM parity_report),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec_id ORDER BY loaded_at DESC NULLS LAST, rf_similarity DESC NULLS LAST, len_ratio DESC NULLS LAST) AS rn FROM v WHERE doc_id IS NOT NULL AND sec_id IS NOT NULL) WHERE rn = 1)
SELECT doc_id, sec_id, rf_similarity, len_ratio, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rf_similarity NULLS LAST, abs(1 - len_ratio) DESC NULLS LAST, sec_id) AS rank FROM w) WHERE rank <= 15""",
    "dehyphenate_lines": f"""WITH {SECTIONS_SQL}, {_LINES}, br AS (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(line, '([A-Za-z]-)([A-Za-z])', '\\1' || chr(1) || '\\2', 'g'), '([A-Za-z]-)([A-Za-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM lin),
x AS (SELECT doc_id, line_no, k, l[k] AS line FROM (SELECT *, unnest(generate_series(1, len(l))) AS k FROM br)),
y AS (SELECT *, coalesce(ends_with(lag(line) OVER w, '-') AND regexp_matches(line, '^[\\p{{L}}\\p{{N}}]'), false) AS j FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, k))
SELECT doc_id, sum((NOT j)::INT)::BIGINT AS lines, (sum(length(line)) - sum(j::INT))::BIGINT AS chars FROM y GROUP BY 1""",
    "merge_wrapped_headers": f"""WITH {SECTIONS_SQL}, {_LINES}, {_CLEAN}, h AS (SELECT *, regexp_matches(line, '{t.HEADER_LINE}') AS h, regexp_matches(line, '{t.PAGE_JUNK}') OR regexp_matches(line, '{t.NOISE_LINE}') AS junk FROM cl),
b AS (SELECT *, h AND regexp_extract(line, '{t.HEADER_LINE}', 2) = '' AS bare, NOT h AND NOT junk AS plain FROM h),
n AS (SELECT *, lead(line) OVER w AS nl, coalesce(lead(plain) OVER w, false) AS np, coalesce(lag(bare) OVER w, false) AND plain AS taken FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, count(*) AS lines, sum(length(CASE WHEN bare AND np THEN '§ ' || regexp_extract(line, '{t.HEADER_LINE}', 1) || ' ' || nl ELSE line END))::BIGINT AS chars FROM n WHERE NOT taken GROUP BY 1""",
    "parity_measures": f"""WITH {SECTIONS_SQL}, lp AS (SELECT * FROM (SELECT doc_id, {_KEY} AS sec_id, heading, text, row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY loaded_at DESC NULLS LAST, sec_key DESC) AS rn FROM sections WHERE doc_id IS NOT NULL) WHERE rn = 1 AND sec_id IS NOT NULL),
j AS (SELECT sec.doc_id, sec.sec_id, {_SQ("coalesce(sec.text, '')")} AS x, {_SQ("coalesce(lp.text, '')")} AS y, sec.heading AS xml_heading, lp.heading AS pdf_heading FROM sec JOIN lp ON lp.doc_id = sec.doc_id AND lp.sec_id = sec.sec_id),
u AS (SELECT *, {_UNI('x')} AS ux, {_UNI('y')} AS uy FROM j)
SELECT doc_id, sec_id, length(x) AS xml_len, length(y) AS pdf_len, round(length(y) / greatest(1, length(x)), 3) AS len_ratio, {_TOK('x')} AS xml_tokens, {_TOK('y')} AS pdf_tokens,
 round(CASE WHEN len(ux) + len(uy) = 0 THEN 1.0 ELSE len(list_intersect(ux, uy)) / len(list_distinct(list_concat(ux, uy))) END, 3) AS jaccard_unigram, xml_heading, pdf_heading FROM u""",
    "xml_parse": f"""WITH s AS (SELECT sec_key, {_NORM("coalesce(heading, '')")} AS heading, {_NORM("coalesce(text, '')")} AS text, {_NORM("coalesce(sec_id, '')")} AS no, hierarchy_path[1] AS h FROM sections),
i AS (SELECT *, regexp_extract(no, '{_LABEL}', 1) AS a, regexp_extract(heading, '{_LABEL}', 1) AS b FROM s),
k AS (SELECT *, regexp_extract(CASE WHEN a <> '' THEN a ELSE b END, '^[^-–]*') AS n FROM i)
SELECT sec_key, '§' || CASE WHEN n = '' THEN 'UNKNOWN' ELSE n END AS sec_id, '§ ' || CASE WHEN n = '' THEN 'UNKNOWN' ELSE n END AS label, heading, md5(text) AS text_md5, CASE WHEN h IS NULL THEN '' ELSE regexp_replace('Subpart ' || h, '^\\s+|\\s+$', '', 'g') END AS path, {_TOK('text')} AS tokens FROM k""",
    "parity_missing": f"WITH {SECTIONS_SQL}, y AS {_REP('parity_report_mirror')} SELECT doc_id, sec_id, 'left_only' AS side FROM sec WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.doc_id = sec.doc_id AND y.sec_id = sec.sec_id) UNION ALL SELECT doc_id, sec_id, 'right_only' FROM y WHERE NOT EXISTS (SELECT 1 FROM sec WHERE y.doc_id = sec.doc_id AND y.sec_id = sec.sec_id)",
}
