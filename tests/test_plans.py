"""What queries leave on disk, and the one-task operators against the spread ones."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.functions import text as t
from lexweave.operators import gists as gs
from lexweave.operators import ranking as rk
from lexweave.operators import stitch as st
from lexweave.operators import terms as tm
from lexweave.plans import ranking_queries as rq
from lexweave.plans.citation_graph import canonical_sections

DATA = "/root/testdata/sf0.01"


def _left_on_disk(spark, folder, query: str) -> int:
    """Bytes in the checkpoint folder once the query has run."""
    spark.sparkContext.setCheckpointDir(str(folder))
    __spark_entry__.queries()[query](spark, DATA).write.format("noop").mode("overwrite").save()
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def _input(*tables: str) -> int:
    return sum(Path(DATA, f"{t}.parquet").stat().st_size for t in tables)


@pytest.mark.parametrize("query", ["edges_merged", "node_centrality"])
def test_edges_store_less_than_they_read(spark, tmp_path, query):
    assert _left_on_disk(spark, tmp_path, query) < 2 * _input("sections", "explicit_refs_flat")


@pytest.mark.parametrize("query", ["deliverable", "full_pipeline"])
def test_summaries_store_less_than_they_read(spark, tmp_path, query):
    assert _left_on_disk(spark, tmp_path, query) < 2 * _input("sections", "explicit_refs_flat", "xml_refs", "gists")


def test_fold_over_batches():
    """Documents that cross batches, and such of which nothing fits."""
    rows = [("a", 0, 9, "x"), ("b", 0, 2, "x"), ("b", 1, 2, "y"), ("b", 3, 1, "z"), ("c", 0, 4, "x"), ("d", 0, 3, "x")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "pos", "n", "block"), r)) for r in rows[i : i + 2]]) for i in range(0, 6, 2)]
    got = [tuple(r.values()) for b in st._fitting(3)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted([("a", None, None, None), rows[1], rows[3], ("c", None, None, None), rows[5]], key=str)


def test_profile_equals_spread_weights(spark):
    """Large documents are weighed by shuffles, others in one task: the same numbers, mixed ones too."""
    rows = {}
    for most in (10**9, 2_500, 0):
        p = rq.Pipeline(spark, DATA, max_task_chars=most)
        rows[most] = {(r.doc_id, r.sec_id): r for r in p.profile.collect()}
    assert rows[0].keys() == rows[2_500].keys() == rows[10**9].keys() and len(rows[0]) == canonical_sections(spark, DATA).count()
    for at, a in rows[10**9].items():
        for b in (rows[0][at], rows[2_500][at]):
            assert (a.pos, a.terms, a.next_sec_id, a.hits, a.bonus, a.heading, a.lead) == (b.pos, b.terms, b.next_sec_id, b.hits, b.bonus, b.heading, b.lead)
            assert a.score == (None if b.score is None else pytest.approx(b.score, abs=1e-12))


@pytest.mark.parametrize("max_features", [3, 7, 20_000])
def test_profiles_equal_tfidf(spark, max_features, monkeypatch):
    monkeypatch.setattr(tm, "CHUNK_WORDS", 20)
    rng = random.Random(max_features)
    made = [(f"d{d}", f"§{d}.{s}", s, s, rng.choices("abcde", k=rng.choice([0, 1, 2, 9]))) for d in range(6) for s in range(rng.choice([1, 2, 8]))]
    df = spark.createDataFrame(made, "doc_id string, sec_id string, idx int, sec_key bigint, words array<string>").coalesce(1)
    grams = F.flatten(F.transform(F.array("words"), lambda w: tm.ngrams(w, 1, 3)))
    weights: dict = {}
    for r in tm.tfidf(df, ["doc_id"], ["sec_id"], grams, max_features=max_features).collect():
        weights.setdefault((r.doc_id, r.sec_id), {})[r.term] = r.w
    got = {(r.doc_id, r.pos): r for r in tm.profiles(df, max_features=max_features, k=4).collect()}
    assert len(got) == len(made)
    for d, s, pos, _, _ in made:
        own, after = weights.get((d, s), {}), weights.get((d, f"§{d[1:]}.{pos + 1}"), {})
        assert got[d, pos].sec_id == s and got[d, pos].terms == min(4, len(own))
        both = [own[x] * after[x] for x in own if x in after]
        assert got[d, pos].next_sec_id == (f"§{d[1:]}.{pos + 1}" if both else None)
        assert got[d, pos].score == (pytest.approx(sum(both)) if both else None)


def _weights(texts, query):
    counts = [Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]) for w in (re.findall(r"\w\w+", x.lower()) for x in [*texts, query])]
    df = Counter(x for c in counts[:-1] for x in c)
    kept = sorted(x for x, n in df.items() if len(texts) == 1 or n <= 0.9 * len(texts))
    v = np.array([[c[x] * (math.log((1 + len(texts)) / (1 + df[x])) + 1) for x in kept] for c in counts])
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(norms > 0, norms, 1)
    return v[:-1], v[-1]


def test_gists_of_many_windows_equal_single_ones(spark, monkeypatch):
    """Windows in step, over small steps, against mmr of one window after the other."""
    monkeypatch.setattr(gs, "STEP_SECTIONS", 3)
    monkeypatch.setattr(gs, "STEP_TERMS", 60)
    rng = random.Random(5)
    say = lambda: rng.choice("The An Any".split()) + " " + " ".join(rng.choices("seal form record duty owner may".split(), k=rng.randint(2, 6))) + "."
    made = [(f"d{d}", f"§{d}.{i}", i, rng.choice([None, "Seal form", "Duty"]), " ".join(say() for _ in range(rng.choice([0, 1, 4])))) for d in range(4) for i in range(rng.choice([1, 5, 14]))]
    s = spark.createDataFrame(made, "doc_id string, sec_id string, pos int, heading string, text string")
    anchors = [r for r in made if rng.random() < 0.6]
    got = {r.anchor_sec_id: r for r in gs.build_gists(s, spark.createDataFrame([r[:2] for r in anchors], "doc_id string, sec_id string"), k=3).collect()}
    sentences = {r.sec_id: r.s for r in s.select("sec_id", gs.gist_sentences(F.col("text")).alias("s")).collect()}
    want = {}
    for d, a, pos, heading, _ in anchors:
        near = [r for r in made if r[0] == d and abs(r[2] - pos) <= 1]
        rows = [(r[1], i, x) for r in near for i, x in enumerate(sentences[r[1]])]
        if rows:
            v, q = _weights([x for _, _, x in rows], " ".join([a, heading or "", *(r[3] or "" for r in near)]))
            want[a] = sorted(rows[i] for i in gs.mmr(v, q, 3, 0.7))
    assert {a: [tuple(x) for x in r.source_spans] for a, r in got.items()} == want and len(want) > 5


def test_texts_are_rewritten_seldom():
    """Words and phrases are matched in the texts as they are: rewriting whole texts took most of the time of full_pipeline."""
    assert "regexp_replace" not in str(tm.term_words(F.col("x"))) and "regexp_replace" not in str(rk.phrase_hits(F.col("h"), F.col("x"), tm.SEEDS))
    assert str(t.token_count(F.col("x"))).count("regexp_replace") == 1


def test_short_ways_equal_long_ones(spark):
    """Words, phrase hits, sentences, leads and token counts of odd texts against their definitions."""
    rng = random.Random(3)
    bits = ["on", " the ", "-", " ", "\u00a0", "\u2009", "Record", "scope", "Scope", "a", "x3", "é", ".", ". ", "Â§", "§", "'", "’", "\r", "\n", "9", "_", "(", "\u0301", "\U0001d4d0", "—", "; ", "한"]
    rows = [(None, None), ("", ""), ("\U0001d4d0scope", "scope\U0001d4d0"), *(("".join(rng.choices(bits, k=rng.randint(0, 9))), "".join(rng.choices(bits, k=rng.randint(0, 25)))) for _ in range(3000))]
    df, h, x = spark.createDataFrame(rows, "h string, x string"), F.col("h"), F.col("x")
    phrases = ["scope", "on the record", "On-the", "o'brien", "-", "한", "scope", "a"]
    wanted = F.array(*[F.lit(" " + " ".join(p.lower().replace("-", " ").split()) + " ") for p in phrases])
    flat = F.array(rk._flat(rk._both(h, x)))
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), r"(?<=[.?!;:])[\s\x{00A0}\x{2009}\x{202F}]+(?=[A-Z(§])"), t.trim_blanks)
    lead = F.array_join(F.slice(F.split(F.coalesce(x, F.lit("")), r"\. "), 1, 2), ". ")
    same = {
        "words": (tm.term_words(x), F.filter(t.all_groups(F.lower(tm.clean_for_terms(x)), tm.TOKEN, 1), lambda w: (w != "") & ~w.isin(tm.STOP))),
        "hits": (rk.phrase_hits(h, x, phrases), F.element_at(F.transform(flat, lambda f: F.size(F.filter(wanted, lambda p: f.contains(p)))), 1)),
        "sentences": (gs.gist_sentences(x), F.filter(parts, lambda s: (F.length(s) >= 2) & (F.size(t.word_list(s)) >= 3))),
        "lead": (st.lead_sentences(x), F.when(t.trim_blanks(lead) == "", "").otherwise(F.concat(F.regexp_replace(lead, r"\.+$", ""), F.lit(".")))),
        "tokens": (t.token_count(x), F.greatest(F.lit(1), F.size(t.word_list(x)))),
    }
    differ = df.select(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in same.items()]).first().asDict()
    assert differ == dict.fromkeys(same, 0) and df.filter(same["hits"][0] > 0).count() > 100
