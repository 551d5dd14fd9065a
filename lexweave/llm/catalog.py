"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.keys import section_id
from lexweave.llm.components import connected_components
from lexweave.llm.distinctive import LONG_LATIN, all_words, distinctive_terms, runs_of
from lexweave.llm.encoding_repair import clean_sequences, garbled_rows, repaired_rows
from lexweave.llm.language import fit_profiles, with_languages, wrong_labels
from lexweave.llm.mixing import mix, normal_source, shares
from lexweave.llm.repetition import BLANK, DecisionList, fit_repetition, repetitive_texts, with_shares
from lexweave.llm.sentences import sentence_rows
from lexweave.llm.tokenizer import with_token_counts, with_token_ids
from lexweave.plans import oracle_parts as o
from lexweave.session import cut, table


def _texts(spark: SparkSession, d: str, *columns: tuple[str, str, str]) -> DataFrame:
    """(tbl, row_id, text) of several tables, each given as (table, key, text column)."""
    parts = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(k).cast("bigint").alias("row_id"), F.col(c).alias("text")) for t, k, c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# 1 ---------------------------------------------------------------------------------------------------------------

P1_TEXTS = (("gists", "gist_id", "gist_text"), ("summary_eval_1200_report", "eval_id", "summary_text"))


def p1_rules(spark: SparkSession, d: str) -> DecisionList:
    return fit_repetition(table(spark, d, "summary_eval_1200_report"), "summary_text", "redundancy")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repetitive_texts(_texts(spark, d, *P1_TEXTS), "text", p1_rules(spark, d)).select("tbl", "row_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return with_shares(_texts(spark, d, *P1_TEXTS), "text").select("tbl", "row_id", F.round("repeated_share", 6).alias("repeated_share"))


# 2 ---------------------------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    flat = table(spark, d, "explicit_refs_flat").filter("match_kind IS NULL OR match_kind <> 'crossdoc'")
    links = flat.select("doc_id", section_id(F.col("src_sec_id")).alias("a"), section_id(F.col("norm_token")).alias("b"))
    groups = connected_components(links, "doc_id", "a", "b")
    return groups.select(F.col("scope").alias("doc_id"), F.col("record").alias("sec_id"), "group_id")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Groups per regulation beside the number that graph_metrics claims."""
    found = p2_found(spark, d).groupBy("doc_id").agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("sections"))
    claimed = table(spark, d, "graph_metrics").groupBy("doc_id").agg(F.max("components").alias("claimed"))
    return found.join(claimed, "doc_id", "left").withColumn("agrees", F.col("groups").eqNullSafe(F.col("claimed").cast("bigint")))


# 3 ---------------------------------------------------------------------------------------------------------------


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves, numbered within each gist."""
    gists = table(spark, d, "gists").select("gist_id", "gist_text").filter("gist_text <> ''")
    clean = _clean(spark, d)
    return sentence_rows(gists, "gist_id", "gist_text", table(spark, d, "sections"), only=lambda df: garbled_rows(df, "_text", clean, garbled=False))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sentences(spark, d).select("gist_id", "sent_start", "sent_end")


# 4 ---------------------------------------------------------------------------------------------------------------

P4_TEXTS = (("sections", "sec_key", "text"), ("gists", "gist_id", "gist_text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The most characteristic terms of a record come first."""
    scored = distinctive_terms(_texts(spark, d, *P4_TEXTS), ["tbl"], ["row_id"], "text", runs_of(LONG_LATIN))
    cases = scored.filter("tf >= 3 AND df <= 5")
    return cases.sortWithinPartitions("tbl", "row_id", F.desc("score"), "term").select("tbl", "row_id", "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every run of letters of every section and gist that occurs in at least two of them, with its score; see p4_words."""
    scored = distinctive_terms(_texts(spark, d, *P4_TEXTS), ["tbl"], ["row_id"], "text", min_df=2)
    return scored.select("tbl", "row_id", "term", "tf", "df", F.round("score", 6).alias("score"))


def p4_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of every section and gist with its score; Han, kana and Thai in pairs of letters."""
    scored = distinctive_terms(_texts(spark, d, *P4_TEXTS), ["tbl"], ["row_id"], "text", all_words)
    return scored.select("tbl", "row_id", "term", "tf", "df", F.round("score", 6).alias("score"))


# 5 ---------------------------------------------------------------------------------------------------------------


def _strings(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id, place, text): every string that may be garbled; place counts the elements of an array from 0."""
    plain = _texts(spark, d, ("gists", "gist_id", "gist_text"), ("summary_eval_3000", "eval_id", "summary_text"))
    plain = plain.select("tbl", "row_id", F.lit(0).alias("place"), "text")
    refs = table(spark, d, "xml_refs").select(F.lit("xml_refs").alias("tbl"), F.col("xref_id").cast("bigint").alias("row_id"), F.posexplode("explicit_refs").alias("place", "text"))
    return plain.unionByName(refs)


def _clean(spark: SparkSession, d: str) -> list[str]:
    return clean_sequences(table(spark, d, "sections"), "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    plain = _texts(spark, d, ("gists", "gist_id", "gist_text"), ("summary_eval_3000", "eval_id", "summary_text")).withColumn("text", F.array("text"))
    rows = plain.unionByName(_texts(spark, d, ("xml_refs", "xref_id", "explicit_refs")))
    return garbled_rows(rows, "text", _clean(spark, d)).select("tbl", "row_id")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled string with what it was; complete says whether all of it could be restored."""
    return repaired_rows(_strings(spark, d), "text", _clean(spark, d)).drop("text")


# 8 ---------------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return with_token_ids(table(spark, d, "documents").select("doc_id", "text"), "text")


# 9 ---------------------------------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_key"), "text")
    sized = cut(with_token_counts(docs, "text"))  # tokenized once, read three times
    return mix(sized, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document, with its place in the training order."""
    mixed, _ = _mixed(spark, d)
    return mixed.withColumn("position", F.round("position", 3))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, rows = _mixed(spark, d)
    return shares(mixed, rows)


# 10 --------------------------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return with_languages(docs, "text", fit_profiles(docs, "text", "lang"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_labels(_segments(spark, d), ["doc_id"], "lang")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document with its language and a confidence."""
    found = _segments(spark, d).select("doc_id", F.explode("segments").alias("s"))
    return found.select("doc_id", "s.seg_start", "s.seg_end", "s.lang", F.round("s.confidence", 4).alias("confidence"))


QUERIES = {
    "p1_found": p1_found,
    "p1_shares": p1_shares,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_sentences": p3_sentences,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p4_words": p4_words,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}

_TERMS = "SELECT tbl, row_id, lower(term) AS term, count(*) AS tf FROM (SELECT tbl, row_id, unnest(regexp_extract_all(text, '{p}')) AS term FROM ({t})) GROUP BY ALL"


def _union(texts: tuple[tuple[str, str, str], ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, {k}::BIGINT AS row_id, {c} AS text FROM {t}" for t, k, c in texts)


def _p1_sql() -> str:
    def grams(items: str, n: int, sep: str) -> str:
        return f"list_transform(generate_series(1, len({items}) - {n - 1}), lambda i: array_to_string(list_slice({items}, i, i + {n - 1}), '{sep}'))"

    return f"""
WITH t AS (SELECT tbl, row_id, lower(coalesce(text, '')) AS s, regexp_matches(coalesce(text, ''), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}]') AS u FROM ({_union(P1_TEXTS)})),
w AS (SELECT *, CASE WHEN u THEN regexp_extract_all(s, '[\\p{{L}}\\p{{M}}]')
  ELSE list_filter(string_split_regex(regexp_replace(s, '[^\\p{{L}}\\p{{M}}{BLANK}]+', '', 'g'), '[{BLANK}]+'), lambda w: w <> '') END AS items FROM t),
g AS (SELECT tbl, row_id, CASE WHEN u THEN {grams('items', 8, '')} ELSE {grams('items', 3, ' ')} END AS runs FROM w)
SELECT tbl, row_id, CASE WHEN len(runs) > 0 THEN 1 - len(list_distinct(runs))::DOUBLE / len(runs) ELSE 0 END AS share FROM g
"""


_P2_LINKS = f"""
WITH RECURSIVE l AS (SELECT doc_id, {o.section_id('src_sec_id')} AS a, {o.section_id('norm_token')} AS b FROM explicit_refs_flat WHERE match_kind IS DISTINCT FROM 'crossdoc'),
e AS (SELECT DISTINCT doc_id, a, b FROM l WHERE doc_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
u AS (SELECT doc_id, a, b FROM e UNION SELECT doc_id, b, a FROM e UNION SELECT doc_id, a, a FROM e UNION SELECT doc_id, b, b FROM e),
r AS (SELECT doc_id, a, b FROM u UNION SELECT r.doc_id, r.a, u.b FROM r JOIN u ON r.doc_id = u.doc_id AND r.b = u.a),
g AS (SELECT doc_id, a AS sec_id, min(b) AS group_id FROM r GROUP BY ALL)
"""

ORACLE = {
    "p1_found": f"SELECT tbl, row_id FROM ({_p1_sql()}) WHERE share >= 0.25",
    "p1_shares": f"SELECT tbl, row_id, round(share, 6) AS repeated_share FROM ({_p1_sql()})",
    "p2_found": _P2_LINKS + "SELECT * FROM g",
    "p2_counts": _P2_LINKS
    + """SELECT f.doc_id, groups, sections, claimed, groups IS NOT DISTINCT FROM claimed AS agrees
FROM (SELECT doc_id, count(DISTINCT group_id) AS groups, count(*) AS sections FROM g GROUP BY 1) f
LEFT JOIN (SELECT doc_id, max(components) AS claimed FROM graph_metrics GROUP BY 1) m ON f.doc_id = m.doc_id""",
    "p4_found": f"""
WITH c AS ({_TERMS.format(p=LONG_LATIN, t=_union(P4_TEXTS))}), s AS (SELECT tbl, term, count(*) AS df FROM c GROUP BY ALL)
SELECT c.tbl, c.row_id, c.term FROM c JOIN s ON c.tbl = s.tbl AND c.term = s.term WHERE tf >= 3 AND df <= 5""",
    "p4_scores": f"""
WITH c AS ({_TERMS.format(p='[\\p{L}\\p{M}]+', t=_union(P4_TEXTS))}),
s AS (SELECT tbl, term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY ALL), n AS (SELECT tbl, sum(cf) AS words FROM s GROUP BY 1),
l AS (SELECT tbl, row_id, sum(tf) AS len FROM c GROUP BY ALL),
p AS (SELECT c.*, df, cf / words AS pc, (tf + 1000.0 * (cf / words)) / (len + 1000.0) AS pd FROM c JOIN s USING (tbl, term) JOIN n USING (tbl) JOIN l USING (tbl, row_id))
SELECT tbl, row_id, term, tf, df, round(pd * ln(pd / pc), 6) AS score FROM p WHERE df >= 2""",
}
