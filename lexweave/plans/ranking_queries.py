"""Queries of terms, ranking and vectors."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexweave.functions import text as t
from lexweave.operators import citations as c
from lexweave.operators import graph as g
from lexweave.operators import ranking as rk
from lexweave.operators import stitch as st
from lexweave.operators import terms as tm
from lexweave.operators import vectors as vec
from lexweave.plans.citation_graph import BASE_SQL, SECTIONS_SQL, _DEG, canonical_sections, whole_documents
from lexweave.session import cut, stored, table


#: Most characters of one document whose terms are weighed inside one task; larger ones are spread by term.
MAX_TASK_CHARS = 4_000_000


class Pipeline:
    """The frames that several steps of one query share; each is made once, when first asked for, and stored.

    ranked: the profile has what ranking and rendering need besides, so that texts are read once.
    """

    def __init__(self, spark: SparkSession, d: str, ranked: bool = True, max_task_chars: int = MAX_TASK_CHARS) -> None:
        self.spark, self.d, self.ranked, self.max_task_chars = spark, d, ranked, max_task_chars

    @cached_property
    def sections(self) -> DataFrame:
        return cut(canonical_sections(self.spark, self.d))

    @cached_property
    def edges(self) -> DataFrame:
        return stored(c.edge_counts(table(self.spark, self.d, "explicit_refs_flat")))

    @cached_property
    def weights(self) -> DataFrame:
        return cut(_weights(self.sections))

    @cached_property
    def large(self) -> DataFrame | None:
        """doc_ids of documents of more than max_task_chars; None if there is none."""
        s = table(self.spark, self.d, "sections").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"))
        large = s.filter(F.col("n") > self.max_task_chars).select("doc_id")
        return None if large.isEmpty() else stored(large)

    @cached_property
    def profile(self) -> DataFrame:
        """(doc_id, sec_id, idx, pos, terms, next_sec_id, score) and, if ranked, (hits, bonus, heading, lead) of every section."""
        more = [_seed_hit_count().alias("hits"), rk.heading_bonus(F.col("heading")).alias("bonus"), "heading", st.lead_sentences(F.col("text")).alias("lead")] if self.ranked else []
        whole = whole_documents(self.spark, self.d, self.large)
        out = tm.profiles(whole.select("doc_id", "sec_id", "idx", "sec_key", tm.term_words(F.col("text")).alias("words"), *more))
        if self.large is not None:
            out = out.unionByName(_spread_profile(cut(canonical_sections(self.spark, self.d).join(self.large, "doc_id", "left_semi")), more))
        return stored(out)

    @property
    def leads(self) -> DataFrame:
        return self.profile.select("doc_id", "sec_id", "heading", "lead")

    @cached_property
    def positions(self) -> DataFrame:
        """(doc_id, sec_id, pos): sections numbered in document order."""
        return numbered(self.sections)

    @cached_property
    def merged(self) -> DataFrame:
        following = self.profile.filter("score IS NOT NULL").select("doc_id", F.col("sec_id").alias("src_sec_id"), F.col("next_sec_id").alias("dst_sec_id"), "score")
        return stored(g.merge_edges(self.edges, following))

    @cached_property
    def waypoints(self) -> DataFrame:
        return stored(_waypoints(self))


def _spread_profile(sections: DataFrame, more: list) -> DataFrame:
    """The profile of documents whose terms are too many for one task: weights are shuffled by document and term."""
    weights, places = cut(_weights(sections)), numbered(sections)
    terms = _top_terms(weights).groupBy("doc_id", "sec_id").agg(F.count("*").alias("terms"))
    following = _implicit(places, weights).select("doc_id", F.col("src_sec_id").alias("sec_id"), F.col("dst_sec_id").alias("next_sec_id"), "score")
    out = sections.select("doc_id", "sec_id", "idx", *more).join(places, ["doc_id", "sec_id"]).join(terms, ["doc_id", "sec_id"], "left")
    return out.join(following, ["doc_id", "sec_id"], "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("bigint")))


def numbered(sections: DataFrame) -> DataFrame:
    pos = F.row_number().over(W.Window.partitionBy("doc_id").orderBy("idx", "sec_key")) - 1
    return sections.select("doc_id", "sec_id", pos.alias("pos"))


def _weights(sections: DataFrame) -> DataFrame:
    return tm.tfidf(sections, ["doc_id"], ["sec_id"], tm.term_list(F.col("text")))


def _top_terms(weights: DataFrame) -> DataFrame:
    return tm.top_terms(weights, ["doc_id", "sec_id"])


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return _top_terms(_weights(canonical_sections(spark, d)))


def term_density(spark: SparkSession, d: str) -> DataFrame:
    sections = canonical_sections(spark, d)
    n = _weights(sections).groupBy("doc_id", "sec_id").agg(F.count("*").alias("terms"))
    s = sections.select("doc_id", "sec_id", t.token_count(tm.clean_for_terms(F.col("text"))).alias("words"))
    return s.join(n, ["doc_id", "sec_id"], "left").select("doc_id", "sec_id", F.round(F.coalesce("terms", F.lit(0)) / F.col("words"), 6).alias("term_density"))


def lexicon_doc_terms(spark: SparkSession, d: str) -> DataFrame:
    return tm.lexicon_doc_terms(top_terms(spark, d))


def lexicon_global(spark: SparkSession, d: str) -> DataFrame:
    found = tm.lexicon_global(lexicon_doc_terms(spark, d))
    return found.select("phrase", "df", F.round(F.col("score") * F.col("df"), 6).alias("score_sum"), "seed")


def _bonuses(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", "sec_id", rk.heading_bonus(F.col("heading")).alias("bonus"))


def heading_bonus(spark: SparkSession, d: str) -> DataFrame:
    return _bonuses(canonical_sections(spark, d))


def _seed_hit_count() -> Column:
    return rk.phrase_hits(F.col("heading"), F.col("text"), [*tm.SEEDS, "maintenance bulletin", "on the record"])


def _seed_hits(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", "sec_id", _seed_hit_count().alias("hits"))


def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    """Seed terms that occur in each section."""
    return _seed_hits(canonical_sections(spark, d))


def lexicon_hits_mined(spark: SparkSession, d: str) -> DataFrame:
    """Seed terms as a table, of any size, that occur in each section."""
    phrases = spark.createDataFrame([(p,) for p in (*tm.SEEDS, "maintenance bulletin", "on the record")], "phrase string")
    return rk.lexicon_hits(canonical_sections(spark, d), ["doc_id", "sec_id"], "heading", "text", phrases)


def lexicon_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon as it is stored: (part, key, phrases): global terms, terms of each document, patterns."""
    return tm.lexicon_bundle(lexicon_doc_terms(spark, d))


def minmax_features(spark: SparkSession, d: str) -> DataFrame:
    s = canonical_sections(spark, d).select("doc_id", "sec_id", F.col("tokens").cast("double").alias("tokens"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("chars"))
    out = rk.minmax(s, ["doc_id"], ["tokens", "chars"])
    return out.select("doc_id", "sec_id", F.round("tokens", 6).alias("tokens"), F.round("chars", 6).alias("chars"))


def _waypoints(p: Pipeline) -> DataFrame:
    return rk.waypoints(p.profile, {"terms": "terms", "lexicon": "hits", "references": _listed_refs(p), "in_degree": _in_degrees(p), "heading": "bonus"})


def _listed_refs(p: Pipeline) -> DataFrame:
    refs = table(p.spark, p.d, "xml_refs").select("doc_id", "sec_id", F.size(F.filter(F.coalesce("explicit_refs", F.array().cast("array<string>")), lambda r: r.rlike(r"^§\d{1,3}\.\d{1,4}"))).alias("value"))
    return refs.groupBy("doc_id", "sec_id").agg(F.max("value").alias("value"))


def _in_degrees(p: Pipeline) -> DataFrame:
    return g.degrees(p.edges).select("doc_id", "sec_id", F.col("in_degree").alias("value"))


def waypoints(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d).waypoints


def waypoints_by_weight(spark: SparkSession, d: str) -> DataFrame:
    """The same with the sum of the term weights as the term feature, where a terms table has it."""
    p = Pipeline(spark, d)
    top = _top_terms(p.weights).groupBy("doc_id", "sec_id").agg(F.sum("score").alias("value"))
    features = {"terms": top, "lexicon": _seed_hits(p.sections).withColumnRenamed("hits", "value"), "references": _listed_refs(p), "in_degree": _in_degrees(p), "heading": _bonuses(p.sections).withColumnRenamed("bonus", "value")}
    return rk.waypoints(p.sections, features)


# Vectors: a label of the embeddings table is a document, a vector one of its sections ------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    place = W.Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sec_id"), (F.row_number().over(place) - 1).alias("idx"), F.col("embedding").alias("vec"))


#: Least similarity of the neighbour queries; it leaves some of the k nearest out.
MIN_SIM = 0.35


def _window(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return vec.window_knn(v, v, window=3, k=2, min_sim=MIN_SIM)


def knn_window(spark: SparkSession, d: str) -> DataFrame:
    return _window(spark, d).withColumn("score", F.round("score", 4)).drop("anchor")


def knn_global(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all vectors of their document."""
    v = _vectors(spark, d)
    return vec.global_knn(v, v.filter("sec_id % 20 = 0"), window=3, k=5, min_sim=MIN_SIM).withColumn("score", F.round("score", 4)).drop("anchor")


def knn_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return vec.both_directions(_window(spark, d)).withColumn("score", F.round("score", 4))


def gist_queries(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of sections whose query vector is that of their gist, if they have one: a vector of the next label stands for it."""
    v = _vectors(spark, d)
    g = v.filter("idx % 3 = 0").select((F.col("doc_id") - 1).alias("doc_id"), "idx", "vec")
    g = g.join(v.select("doc_id", "idx", "sec_id"), ["doc_id", "idx"]).select("doc_id", "sec_id", "vec")
    return vec.window_knn(v, vec.query_vectors(v, g), window=2, k=1, min_sim=MIN_SIM).withColumn("score", F.round("score", 4)).drop("anchor")


def _implicit(s: DataFrame, w: DataFrame) -> DataFrame:
    """Similarity edges between neighbouring sections (s: numbered): cosine of their term weights w."""
    a = s.alias("a").join(s.withColumn("pos", F.col("pos") - 1).alias("b"), ["doc_id", "pos"]).select("doc_id", F.col("a.sec_id").alias("src_sec_id"), F.col("b.sec_id").alias("dst_sec_id"))
    x, y = w.withColumnRenamed("sec_id", "src_sec_id").withColumnRenamed("w", "wa"), w.withColumnRenamed("sec_id", "dst_sec_id").withColumnRenamed("w", "wb")
    return a.join(x, ["doc_id", "src_sec_id"]).join(y, ["doc_id", "dst_sec_id", "term"]).groupBy("doc_id", "src_sec_id", "dst_sec_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def edges_merged(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(spark, d, ranked=False).merged.select("doc_id", "src_sec_id", "dst_sec_id", "edge_type", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))


def node_centrality(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline(spark, d, ranked=False)
    out = g.centrality(p.merged, p.profile)
    return out.select("doc_id", "sec_id", *[F.round(x, 6).alias(x) for x in ("in_weight", "out_weight", "centrality")])


QUERIES = {
    "tfidf_terms": top_terms,
    "term_density": term_density,
    "lexicon_doc_terms": lexicon_doc_terms,
    "lexicon_global": lexicon_global,
    "heading_bonus": heading_bonus,
    "lexicon_hits": lexicon_hits,
    "lexicon_hits_joined": lexicon_hits_mined,
    "lexicon_bundle": lexicon_bundle,
    "minmax_features": minmax_features,
    "waypoints": waypoints,
    "waypoints_by_weight": waypoints_by_weight,
    "knn_window": knn_window,
    "knn_global": knn_global,
    "knn_bidirectional": knn_bidirectional,
    "knn_gist_queries": gist_queries,
    "edges_merged": edges_merged,
    "node_centrality": node_centrality,
}

_BLANK = f"{t.WS}+"
_STOPS = ", ".join(f"'{w}'" for w in tm.STOP)
_CT = f"trim(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\\r', ' ', 'g'), 'Â§', '§'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_§.\\-/''() ]+', ' ', 'g'), '{_BLANK}', ' ', 'g'))"
_TOKEN_SQL = tm.TOKEN.replace("'", "''")
_G = lambda n: f"CASE WHEN len(w) >= {n} THEN list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE [] END"
TFIDF_SQL = f"""tok AS (SELECT doc_id, sec_id, list_filter(regexp_extract_all(lower({_CT}), '{_TOKEN_SQL}', 1), lambda x: x <> '' AND x NOT IN ({_STOPS})) AS w FROM sec),
tf AS (SELECT doc_id, sec_id, term, count(*) AS tf FROM (SELECT doc_id, sec_id, unnest(list_concat(list_concat({_G(1)}, {_G(2)}), {_G(3)})) AS term FROM tok) GROUP BY ALL),
nn AS (SELECT doc_id, count(*) AS n FROM sec GROUP BY 1),
voc AS (SELECT * FROM (SELECT v.*, n, row_number() OVER (PARTITION BY v.doc_id ORDER BY cf DESC, term) AS rk FROM (SELECT doc_id, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL) v JOIN nn ON nn.doc_id = v.doc_id WHERE df >= 2 AND df <= 0.98 * n) WHERE rk <= 20000),
wt AS (SELECT tf.doc_id, tf.sec_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN voc ON voc.doc_id = tf.doc_id AND voc.term = tf.term),
tw AS (SELECT doc_id, sec_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sec_id)) AS w FROM wt),
top AS (SELECT * FROM (SELECT doc_id, sec_id, term, round(w, 6) AS score, row_number() OVER (PARTITION BY doc_id, sec_id ORDER BY round(w, 6) DESC, term) AS rank FROM tw) WHERE rank <= 25)"""
_STEM_SQL = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tm.STEMS.items()) + " ELSE x END"
_PH = f"""array_to_string(list_transform(list_filter(string_split(lower(regexp_replace(trim(regexp_replace(replace(term, 'Â§', '§'), '{_BLANK}', ' ', 'g')), '^[^\\p{{L}}\\p{{N}}_§]+|[^\\p{{L}}\\p{{N}}_)]+$', '', 'g')), ' '), lambda x: x <> '' AND x NOT IN ({', '.join(f"'{w}'" for w in tm.PHRASE_STOP)}) AND NOT (regexp_matches(x, '[0-9]') AND length(x) <= 2)), lambda x: {_STEM_SQL}), ' ')"""
_USE = f"phrase <> '' AND phrase NOT IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in tm.SOFT_STOP)}) AND (contains(phrase, ' ') OR phrase IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in sorted(set(tm.STEMS.values())))})) AND NOT contains(phrase, '''')"
_LEX = f"""lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM (SELECT doc_id, phrase, max(score) AS score FROM (SELECT doc_id, {_PH} AS phrase, score FROM top) WHERE {_USE} GROUP BY ALL)) WHERE rank <= 12)"""
_BONUS = "CASE WHEN regexp_matches(coalesce(heading, ''), '(?i)\\b(definitions?|applicability)\\b') THEN 1.0 WHEN regexp_matches(coalesce(heading, ''), '(?i)\\b(purpose|scope|authority|compliance|reporting)\\b') THEN 0.5 ELSE 0.0 END"
_PHRASES = [p.lower() for p in (*tm.SEEDS, "maintenance bulletin", "on the record")]
_HAY = "lower(coalesce(heading, '') || chr(10) || coalesce(text, ''))"
_HITS = " + ".join(f"(regexp_matches({_HAY}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])" + p.replace(" ", r"[\s\-]+") + "($|[^\\p{L}\\p{M}\\p{N}_])'))::INT" for p in _PHRASES)
_MM = lambda c: f"round(CASE WHEN max({c}) OVER p - min({c}) OVER p <= 1e-9 * greatest(abs(max({c}) OVER p), abs(min({c}) OVER p)) THEN 0 ELSE ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) END, 6)"
_MMR = lambda c: _MM(c).removeprefix("round(").removesuffix(", 6)")
_EMB = "em AS (SELECT label AS doc_id, vec_id AS sec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS vec FROM embeddings)"
_KW = f"kw AS (SELECT doc_id, src, dst, score, rank FROM (SELECT a.doc_id, a.sec_id AS src, b.sec_id AS dst, list_dot_product(a.vec, b.vec) AS score, row_number() OVER (PARTITION BY a.doc_id, a.sec_id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.idx) AS rank FROM em a JOIN em b ON a.doc_id = b.doc_id AND a.idx <> b.idx AND b.idx BETWEEN a.idx - 3 AND a.idx + 3) WHERE rank <= 2 AND score >= {MIN_SIM})"
_IMP = """ps AS (SELECT doc_id, sec_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sec_key) AS pos FROM sec),
imp AS (SELECT a.doc_id, a.sec_id AS src_sec_id, b.sec_id AS dst_sec_id, sum(x.w * y.w) AS score FROM ps a JOIN ps b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN tw x ON x.doc_id = a.doc_id AND x.sec_id = a.sec_id JOIN tw y ON y.doc_id = b.doc_id AND y.sec_id = b.sec_id AND y.term = x.term GROUP BY ALL),
mer AS (SELECT doc_id, src_sec_id, dst_sec_id, edge_type, score, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, src_sec_id, dst_sec_id ORDER BY weight DESC, edge_type) AS rn FROM (SELECT doc_id, src_sec_id, dst_sec_id, 'explicit' AS edge_type, NULL::DOUBLE AS score, 1.0::DOUBLE AS weight FROM base UNION ALL SELECT doc_id, src_sec_id, dst_sec_id, 'implicit', score, 0.4 * score FROM imp) WHERE src_sec_id <> dst_sec_id) WHERE rn = 1)"""

ORACLE = {
    "tfidf_terms": f"WITH {SECTIONS_SQL}, {TFIDF_SQL} SELECT * FROM top",
    "term_density": f"WITH {SECTIONS_SQL}, {TFIDF_SQL} SELECT sec.doc_id, sec.sec_id, round(coalesce(k, 0) / greatest(1, len(list_filter(string_split({_CT}, ' '), lambda x: x <> ''))), 6) AS term_density FROM sec LEFT JOIN (SELECT doc_id, sec_id, count(*) AS k FROM tw GROUP BY ALL) c ON c.doc_id = sec.doc_id AND c.sec_id = sec.sec_id",
    "lexicon_doc_terms": f"WITH {SECTIONS_SQL}, {TFIDF_SQL}, {_LEX} SELECT * FROM lex",
    "lexicon_global": f"WITH {SECTIONS_SQL}, {TFIDF_SQL}, {_LEX}, gl AS (SELECT phrase, count(*) AS df, avg(score) AS score, false AS seed FROM lex GROUP BY 1), sd AS (SELECT DISTINCT {_PH} AS phrase FROM (SELECT unnest([{', '.join(f'{chr(39)}{w}{chr(39)}' for w in tm.SEEDS)}]) AS term)) SELECT phrase, df, round(score * df, 6) AS score_sum, seed FROM gl UNION ALL SELECT phrase, 0, 0.0, true FROM sd WHERE phrase NOT IN (SELECT phrase FROM gl)",
    "heading_bonus": f"WITH {SECTIONS_SQL} SELECT doc_id, sec_id, {_BONUS} AS bonus FROM sec",
    "lexicon_hits_joined": f"WITH {SECTIONS_SQL} SELECT doc_id, sec_id, ({_HITS})::BIGINT AS hits FROM sec",
    "lexicon_bundle": f"WITH {SECTIONS_SQL}, {TFIDF_SQL}, {_LEX} SELECT 'document' AS part, doc_id AS key, string_agg(phrase, '|' ORDER BY phrase) AS phrases FROM lex GROUP BY 2 UNION ALL SELECT 'global', '', string_agg(phrase, '|' ORDER BY phrase) FROM (SELECT phrase FROM lex UNION SELECT {_PH} FROM (SELECT unnest([{', '.join(f'{chr(39)}{w}{chr(39)}' for w in tm.SEEDS)}]) AS term)) UNION ALL SELECT 'pattern', k, v FROM (SELECT unnest([{', '.join(f'{chr(39)}{k}{chr(39)}' for k in tm.PATTERNS)}]) AS k, unnest([{', '.join(f'{chr(39)}{v}{chr(39)}' for v in tm.PATTERNS.values())}]) AS v)",
    "lexicon_hits": f"WITH {SECTIONS_SQL} SELECT doc_id, sec_id, {_HITS} AS hits FROM sec",
    "minmax_features": f"WITH {SECTIONS_SQL}, f AS (SELECT doc_id, sec_id, coalesce(tokens, 0)::DOUBLE AS t, coalesce(length(text), 0)::DOUBLE AS c FROM sec) SELECT doc_id, sec_id, {_MM('t')} AS tokens, {_MM('c')} AS chars FROM f WINDOW p AS (PARTITION BY doc_id)",
    "waypoints": f"""WITH {SECTIONS_SQL}, {BASE_SQL}, {_DEG}, {TFIDF_SQL},
 rf AS (SELECT doc_id, sec_id, max(len(list_filter(coalesce(explicit_refs, []), lambda r: regexp_matches(r, '^§\\d{{1,3}}\\.\\d{{1,4}}')))) AS v FROM xml_refs GROUP BY ALL),
 f AS (SELECT sec.doc_id, sec.sec_id, sec.idx, coalesce(k.k, 0)::DOUBLE AS a, ({_HITS})::DOUBLE AS b, coalesce(rf.v, 0)::DOUBLE AS c, coalesce(deg.in_degree, 0)::DOUBLE AS d, ({_BONUS})::DOUBLE AS e FROM sec
  LEFT JOIN (SELECT doc_id, sec_id, count(*) AS k FROM top GROUP BY ALL) k ON k.doc_id = sec.doc_id AND k.sec_id = sec.sec_id LEFT JOIN rf ON rf.doc_id = sec.doc_id AND rf.sec_id = sec.sec_id LEFT JOIN deg ON deg.doc_id = sec.doc_id AND deg.sec_id = sec.sec_id),
 s AS (SELECT doc_id, sec_id, idx, round(0.45 * {_MMR('a')} + 0.25 * {_MMR('b')} + 0.2 * {_MMR('c')} + 0.05 * {_MMR('d')} + 0.05 * {_MMR('e')}, 6) AS score FROM f WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, sec_id, score, 1 AS "window", 'terms+lexicon+references' AS reason, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx, sec_id) AS rank FROM s) WHERE rank <= 12""",
    "waypoints_by_weight": f"""WITH {SECTIONS_SQL}, {BASE_SQL}, {_DEG}, {TFIDF_SQL},
 rf AS (SELECT doc_id, sec_id, max(len(list_filter(coalesce(explicit_refs, []), lambda r: regexp_matches(r, '^§\\d{{1,3}}\\.\\d{{1,4}}')))) AS v FROM xml_refs GROUP BY ALL),
 f AS (SELECT sec.doc_id, sec.sec_id, sec.idx, coalesce(k.k, 0)::DOUBLE AS a, ({_HITS})::DOUBLE AS b, coalesce(rf.v, 0)::DOUBLE AS c, coalesce(deg.in_degree, 0)::DOUBLE AS d, ({_BONUS})::DOUBLE AS e FROM sec
  LEFT JOIN (SELECT doc_id, sec_id, sum(score) AS k FROM top GROUP BY ALL) k ON k.doc_id = sec.doc_id AND k.sec_id = sec.sec_id LEFT JOIN rf ON rf.doc_id = sec.doc_id AND rf.sec_id = sec.sec_id LEFT JOIN deg ON deg.doc_id = sec.doc_id AND deg.sec_id = sec.sec_id),
 s AS (SELECT doc_id, sec_id, idx, round(0.45 * {_MMR('a')} + 0.25 * {_MMR('b')} + 0.2 * {_MMR('c')} + 0.05 * {_MMR('d')} + 0.05 * {_MMR('e')}, 6) AS score FROM f WINDOW p AS (PARTITION BY doc_id))
SELECT doc_id, sec_id, score, 1 AS "window", 'terms+lexicon+references' AS reason, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx, sec_id) AS rank FROM s) WHERE rank <= 12""",
    "knn_window": f"WITH {_EMB}, {_KW} SELECT doc_id, src, dst, round(score, 4) AS score, rank, 'implicit_knn_window' AS method FROM kw",
    "knn_global": f"WITH {_EMB} SELECT doc_id, src, dst, round(score, 4) AS score, rank, 'implicit_knn_global' AS method FROM (SELECT a.doc_id, a.sec_id AS src, b.sec_id AS dst, list_dot_product(a.vec, b.vec) AS score, row_number() OVER (PARTITION BY a.doc_id, a.sec_id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.idx) AS rank FROM em a JOIN em b ON a.doc_id = b.doc_id AND abs(a.idx - b.idx) > 3 WHERE a.sec_id % 20 = 0) WHERE rank <= 5 AND score >= {MIN_SIM}",
    "knn_gist_queries": f"""WITH {_EMB}, qv AS (SELECT a.doc_id, a.sec_id, a.idx, CASE WHEN a.idx % 3 = 0 AND b.vec IS NOT NULL THEN b.vec ELSE a.vec END AS vec FROM em a LEFT JOIN em b ON b.doc_id = a.doc_id + 1 AND b.idx = a.idx)
SELECT doc_id, src, dst, round(score, 4) AS score, rank, 'implicit_knn_window' AS method FROM (SELECT a.doc_id, a.sec_id AS src, b.sec_id AS dst, list_dot_product(a.vec, b.vec) AS score, row_number() OVER (PARTITION BY a.doc_id, a.sec_id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.idx) AS rank FROM qv a JOIN em b ON a.doc_id = b.doc_id AND a.idx <> b.idx AND b.idx BETWEEN a.idx - 2 AND a.idx + 2) WHERE rank <= 1 AND score >= {MIN_SIM}""",
    "knn_bidirectional": f"WITH {_EMB}, {_KW} SELECT doc_id, src, dst, round(score, 4) AS score, rank, method FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, src, dst ORDER BY anchor, rank, method) AS rn FROM (SELECT kw.doc_id, src, dst, score, rank, idx AS anchor, 'implicit_knn_window' AS method FROM kw JOIN em ON em.doc_id = kw.doc_id AND em.sec_id = kw.src UNION ALL SELECT kw.doc_id, dst, src, score, rank, idx, 'implicit_knn_window_bidir' FROM kw JOIN em ON em.doc_id = kw.doc_id AND em.sec_id = kw.src)) WHERE rn = 1",
    "edges_merged": f"WITH {SECTIONS_SQL}, {BASE_SQL}, {TFIDF_SQL}, {_IMP} SELECT doc_id, src_sec_id, dst_sec_id, edge_type, round(score, 6) AS score, round(weight, 6) AS weight FROM mer",
    "node_centrality": f"WITH {SECTIONS_SQL}, {BASE_SQL}, {TFIDF_SQL}, {_IMP}, j AS (SELECT sec.doc_id, sec.sec_id, coalesce(i.w, 0) AS i, coalesce(o.w, 0) AS o FROM sec LEFT JOIN (SELECT doc_id, dst_sec_id, sum(weight) AS w FROM mer GROUP BY ALL) i ON i.doc_id = sec.doc_id AND i.dst_sec_id = sec.sec_id LEFT JOIN (SELECT doc_id, src_sec_id, sum(weight) AS w FROM mer GROUP BY ALL) o ON o.doc_id = sec.doc_id AND o.src_sec_id = sec.sec_id) SELECT doc_id, sec_id, round(i, 6) AS in_weight, round(o, 6) AS out_weight, round(i / greatest(1e-9, max(i) OVER (PARTITION BY doc_id)), 6) AS centrality FROM j",
}
