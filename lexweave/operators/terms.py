"""Weighted terms and the lexicon."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import text as t
from lexweave.operators.graph import top_k

#: Words that are no terms.
STOP = (
    "the a an and or of to in for on by with as at from that this these those is are was were be being been it its shall must may should can will not no any all each such "
    "section sections subsection subsections paragraph paragraphs subpart subparts part parts title chapter cfr usc code"
).split()
#: Words dropped from key phrases.
PHRASE_STOP = "a an and are as at be by for from has have in into is it its of on or that the their there these this to under with without such shall may can will must not".split()
#: Phrases that are no lexicon terms.
SOFT_STOP = ["reserved", "final", "age", "advance", "vehicle", "motor", "determination", "use your benefits", "responsibilities"]
#: Forms of legal words and their stem.
STEMS = {
    "applicability": "applicability", "applicable": "applicability", "definition": "definition", "definitions": "definition", "authority": "authority", "purpose": "purpose", "scope": "scope",
    "penalties": "penalty", "penalty": "penalty", "compliance": "compliance", "requirement": "requirement", "requirements": "requirement", "reporting": "reporting", "report": "reporting",
    "reports": "reporting", "confidentiality": "confidentiality", "retaliation": "retaliation", "eligibility": "eligibility", "eligible": "eligibility", "payment": "payment", "payments": "payment",
    "investigation": "investigation", "training": "training", "recordkeeping": "recordkeeping", "supervision": "supervision", "grievance": "grievance",
}
#: Seed terms.
SEEDS = "Applicability Definitions Authority Purpose Scope Compliance Penalties Reporting Confidentiality Retaliation Eligibility Payment Investigation Training Recordkeeping Supervision Grievance".split()
#: Patterns that a lexicon carries.
PATTERNS = {"section_label": r"§{1,2}\s*\d{1,3}\.\d{1,4}(?:\([a-z0-9ivxl]+\))*", "definitions_heading": r"(?i)\bdefinitions?\b", "applicability_heading": r"(?i)\bapplicability\b"}
#: A word of two characters or more, as group 1: where no word is before it, a letter, then letters, digits, hyphens,
#: apostrophes, of which the last two do not end it. The first branch passes over what starts with a digit.
TOKEN = r"[\p{M}\p{N}_][\p{L}\p{M}\p{N}_]*|(\p{L}[\p{L}\p{M}\p{N}_\-']*[\p{L}\p{M}\p{N}_])"


def clean_for_terms(c: Column) -> Column:
    s = F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", " "), F.lit("Â§"), F.lit("§"))
    return t.squeeze_blanks(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}_§.\-/'() ]+", " "))


def _ngrams_of(words: Column, n: int) -> Column:
    every = F.transform(words, lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, n)]))
    return F.slice(every, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def ngrams(words: Column, low: int, high: int) -> Column:
    return F.concat(*[_ngrams_of(words, n) for n in range(low, high + 1)])


def term_words(c: Column) -> Column:
    """The lower-case words of clean_for_terms that are no stop words.

    What clean_for_terms makes blanks of parts words anyway, so only its letter is taken out.
    """
    s = F.replace(F.coalesce(c, F.lit("")), F.lit("Â§"), F.lit("§"))
    return F.filter(t.all_groups(F.lower(s), TOKEN, 1), lambda w: (w != "") & ~w.isin(STOP))


def term_list(c: Column, low: int = 1, high: int = 3) -> Column:
    """n-grams of the lower-case words that are no stop words (which leave before n-grams are made)."""
    return F.flatten(F.transform(F.array(term_words(c)), lambda w: ngrams(w, low, high)))


def tfidf(df: DataFrame, doc: list[str], record: list[str], terms: Column, min_df: int = 2, max_df: float = 0.98, max_features: int = 20_000, sublinear: bool = True) -> DataFrame:
    """(doc..., record..., term, w): weights (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), unit length per record.

    doc: columns of the collection whose vocabulary is shared. The vocabulary keeps terms of min_df to max_df * N
    records, of these the max_features most frequent (ties in term order). Records are counted even if they have no term.
    """
    keys = [*doc, *record]
    # Terms are shuffled once, by document and term: counts, vocabulary and weights all read that one exchange. Most
    # terms leave with the vocabulary, so what is shuffled again by record, for the norms, is little. The sides that are
    # hashed are small: max_features terms a document, a row a record.
    n = df.select(*keys).distinct().groupBy(*doc).agg(F.count("*").alias("n"))
    by_term = df.select(*keys, F.explode(terms).alias("term")).repartition(*doc, "term")
    tf = by_term.groupBy(*doc, "term", *record).agg(F.count("*").alias("tf"))
    vocabulary = tf.groupBy(*doc, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter(F.col("df") >= min_df).join(n, doc)
    vocabulary = top_k(vocabulary.filter(F.col("df") <= max_df * F.col("n")), doc, [F.desc("cf"), F.col("term")], max_features)
    weight = (1 + F.log("tf") if sublinear else F.col("tf").cast("double")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    weighted = tf.join(vocabulary.select(*doc, "term", "df", "n").hint("shuffle_hash"), [*doc, "term"]).select(*keys, "term", weight.alias("w")).repartition(*keys)
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms.hint("shuffle_hash"), keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


#: Most words of whole documents whose terms are weighed at once; a larger document is weighed alone.
CHUNK_WORDS = 300_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole documents, whose rows come one after the other, of about CHUNK_WORDS words."""
    held: list[pa.RecordBatch] = []

    def parts() -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        docs = table["doc_id"]
        starts = np.flatnonzero(np.r_[True, pc.not_equal(docs[1:], docs[:-1]).to_numpy()]) if len(table) > 1 else np.array([0])
        words = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(table["words"]), 0).to_numpy())]
        first = starts[np.flatnonzero(np.diff(words[starts] // CHUNK_WORDS, prepend=-1))]
        for a, b in zip(first, [*first[1:], len(table)]):
            yield table.slice(a, b - a)

    for batch in batches:
        if not batch.num_rows:
            continue
        docs = batch.column(batch.schema.get_field_index("doc_id"))
        if held and held[-1].column(batch.schema.get_field_index("doc_id"))[-1] != docs[0]:
            yield from parts()
            held = []
        changes = np.flatnonzero(pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False))
        if len(changes):
            held.append(batch.slice(0, changes[-1] + 1))
            yield from parts()
            held = [batch.slice(changes[-1] + 1)]
        else:
            held.append(batch)
    if held:
        yield from parts()


def _weighed(words: pa.ListArray, doc: np.ndarray, n: np.ndarray, high: int, min_df: int, max_df: float, max_features: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each length of terms (keys, weights, terms): a key is row * terms + term, in ascending order; see tfidf.

    doc: the document of each row, n: rows of each document. A term of min_df records is made of shorter ones that have
    as many, so longer terms are counted only where both shorter ones are left.
    """
    flat = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    code, at, size = flat.indices.to_numpy().astype(np.int64), np.arange(len(row)), max(1, len(flat.dictionary))
    vocabulary, names = size, [lambda g: flat.dictionary[g].as_py()]
    unigram, found = code, []
    for length in range(1, high + 1):
        keys, back, tf = np.unique(row[at] * size + code, return_inverse=True, return_counts=True)
        terms, of, df = np.unique(doc[keys // size] * size + keys % size, return_inverse=True, return_counts=True)
        found.append((keys, tf, terms, of, df, np.bincount(of, tf, len(terms)), size))
        if length < high:
            alive = np.zeros(len(row) + 1, bool)
            alive[at] = (df >= min_df)[of][back]
            here = alive[at] & alive[np.minimum(at + 1, len(row))]
            here &= (at + length < len(row)) & (row[at] == row[np.minimum(at + length, len(row) - 1)])
            pairs, code = np.unique(code[here] * vocabulary + unigram[at[here] + length], return_inverse=True)
            at, size = at[here], max(1, len(pairs))
            names.append(lambda g, p=pairs, shorter=names[-1]: f"{shorter(int(p[g] // vocabulary))} {names[0](int(p[g] % vocabulary))}")
    kept = [(df >= min_df) & (df <= max_df * n[terms // size]) for _, _, terms, _, df, _, size in found]
    sizes = sum(np.bincount(x[2][k] // x[6], minlength=len(n)) for x, k in zip(found, kept))
    for d in np.flatnonzero(sizes > max_features):
        own = [(-x[5][i], names[j](int(x[2][i] % x[6])), j, i) for j, x in enumerate(found) for i in np.flatnonzero(kept[j] & (x[2] // x[6] == d))]
        for _, _, j, i in sorted(own)[max_features:]:
            kept[j][i] = False
    out, squares = [], np.zeros(len(words))
    for (keys, tf, terms, of, df, _, size), k in zip(found, kept):
        of, keys, tf = of[k[of]], keys[k[of]], tf[k[of]]
        w = (1 + np.log(tf)) * (np.log((1 + n[terms[of] // size]) / (1 + df[of])) + 1)
        squares += np.bincount(keys // size, w * w, len(words))
        out.append((keys, w, size))
    return [(keys, w / np.sqrt(squares)[keys // size], size) for keys, w, size in out]


def _profile(table: pa.Table, high: int, min_df: int, max_df: float, max_features: int, k: int) -> pa.Table:
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("doc_id", "idx", "sec_key")], null_placement="at_start")).combine_chunks()
    docs, rows = table["doc_id"], len(table)
    new = np.r_[True, pc.not_equal(docs[1:], docs[:-1]).to_numpy()] if rows > 1 else np.array([True])
    doc = np.cumsum(new) - 1
    n = np.bincount(doc)
    terms, score, met = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows, bool)
    for keys, w, size in _weighed(table["words"].chunk(0), doc, n, high, min_df, max_df, max_features):
        row = keys // size
        terms += np.bincount(row, minlength=rows)
        there = np.searchsorted(keys, keys + size)
        hit = np.flatnonzero(there < len(keys))
        hit = hit[keys[there[hit]] == keys[hit] + size]
        hit = hit[doc[row[hit]] == doc[row[hit] + 1]]
        score += np.bincount(row[hit], w[hit] * w[there[hit]], rows)
        met[row[hit]] = True
    following = pc.if_else(pa.array(met), table["sec_id"].take(pa.array(np.minimum(np.arange(rows) + 1, rows - 1))), pa.scalar(None, pa.string()))
    pos = np.arange(rows) - np.flatnonzero(new)[doc]
    out = table.drop_columns(["words", "sec_key"])
    for name, c in (("pos", pa.array(pos, pa.int32())), ("terms", pa.array(np.minimum(terms, k), pa.int64())), ("next_sec_id", following), ("score", pa.array(score, mask=~met))):
        out = out.append_column(name, c)
    return out


def profiles(sections: DataFrame, high: int = 3, min_df: int = 2, max_df: float = 0.98, max_features: int = 20_000, k: int = 25) -> DataFrame:
    """Of every section what ranking and neighbour edges take from its tf-idf weights, which are not written anywhere.

    sections: (doc_id, sec_id, idx, sec_key, words, others...) with the rows of a document one after the other in one
    partition; the others are handed on. Returns (doc_id, sec_id, idx, others..., pos, terms, next_sec_id, score): place
    in the document, number of top terms (k at most), the next section if both share a term, and their cosine.
    Vocabulary and weights are those of tfidf over n-grams of up to ``high`` words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            yield from _profile(table, high, min_df, max_df, max_features, k).to_batches()

    kept = [f for f in sections.schema.fields if f.name not in ("words", "sec_key")]
    added = [T.StructField("pos", T.IntegerType()), T.StructField("terms", T.LongType()), T.StructField("next_sec_id", T.StringType()), T.StructField("score", T.DoubleType())]
    return sections.mapInArrow(run, T.StructType([*kept, *added]))


def top_terms(weights: DataFrame, keys: list[str], k: int = 25) -> DataFrame:
    """The k heaviest terms of every record, at six decimals, ties in term order."""
    rounded = weights.withColumn("score", F.round("w", 6)).drop("w")
    return top_k(rounded, keys, [F.desc("score"), F.col("term")], k)


def normalize_phrase(c: Column) -> Column:
    s = t.squeeze_blanks(F.replace(F.coalesce(c, F.lit("")), F.lit("Â§"), F.lit("§")))
    s = F.lower(F.regexp_replace(s, r"^[^\p{L}\p{N}_§]+|[^\p{L}\p{N}_)]+$", ""))
    words = F.filter(F.split(s, " "), lambda w: (w != "") & ~w.isin(PHRASE_STOP) & ~(w.rlike("[0-9]") & (F.length(w) <= 2)))
    stems = F.create_map(*[F.lit(x) for pair in STEMS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(stems, w), w)), " ")


def useful_phrase(c: Column) -> Column:
    return (c != "") & ~c.isin(SOFT_STOP) & (c.contains(" ") | c.isin(sorted(set(STEMS.values())))) & ~c.contains("'")


def lexicon_doc_terms(top: DataFrame, per_doc: int = 12) -> DataFrame:
    """(doc_id, phrase, score, rank): the best normalized phrases of every document."""
    phrases = top.select("doc_id", normalize_phrase(F.col("term")).alias("phrase"), "score")
    best = phrases.filter(useful_phrase(F.col("phrase"))).groupBy("doc_id", "phrase").agg(F.max("score").alias("score"))
    return top_k(best, ["doc_id"], [F.desc("score"), F.col("phrase")], per_doc)


def lexicon_global(doc_terms: DataFrame, min_df: int = 1, seeds: list[str] | None = None) -> DataFrame:
    """(phrase, df, score, seed): phrases of at least min_df documents, and the seeds that are not among them."""
    g = doc_terms.groupBy("phrase").agg(F.count("*").alias("df"), F.avg("score").alias("score")).filter(F.col("df") >= min_df).withColumn("seed", F.lit(False))
    s = doc_terms.sparkSession.createDataFrame([(x,) for x in (SEEDS if seeds is None else seeds)], "phrase string").select(normalize_phrase(F.col("phrase")).alias("phrase")).distinct()
    s = s.join(g, "phrase", "left_anti").select("phrase", F.lit(0).cast("bigint").alias("df"), F.lit(0.0).alias("score"), F.lit(True).alias("seed"))
    return g.unionByName(s)


def lexicon_bundle(doc_terms: DataFrame, min_df: int = 1, seeds: list[str] | None = None) -> DataFrame:
    """(part, key, phrases): the lexicon as one table. Parts are global (one row), document (key is doc_id) and pattern
    (key is its name, phrases the pattern); phrases are parted by ``|``, in code point order.

    The global row holds all phrases of at least min_df documents; raise min_df with the number of documents.
    """
    joined = F.array_join(F.array_sort(F.collect_set("phrase")), "|").alias("phrases")
    docs = doc_terms.groupBy(F.col("doc_id").alias("key")).agg(joined).select(F.lit("document").alias("part"), "key", "phrases")
    every = lexicon_global(doc_terms, min_df, seeds).agg(joined).select(F.lit("global").alias("part"), F.lit("").alias("key"), "phrases")
    patterns = doc_terms.sparkSession.createDataFrame([("pattern", k, v) for k, v in PATTERNS.items()], "part string, key string, phrases string")
    return docs.unionByName(every).unionByName(patterns)
