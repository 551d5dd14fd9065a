"""Extractive gists: sentences of an anchor's window, picked by maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as t

#: Fixed value: where a sentence ends for gists (the next one starts with a capital, a parenthesis or a section sign).
SPLIT = rf"(?={t.WS})(?<=[.?!;:]){t.WS}+(?=[A-Z(§])"  # the first group only saves time
_WORD = regex.compile(r"\w\w+")


def gist_sentences(c: Column) -> Column:
    """Sentences of two characters and three words at least."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SPLIT), t.trim_blanks)
    return F.filter(parts, lambda s: (F.length(s) >= 2) & s.rlike(f"{t.NO_WS}{t.WS}+{t.NO_WS}+{t.WS}+{t.NO_WS}"))


def mmr(vectors: np.ndarray, query: np.ndarray, k: int, lam: float) -> list[int]:
    """Indices in the order picked; ties go to the lowest index."""
    sim = vectors @ query
    picked: list[int] = []
    nearest = np.full(len(sim), -np.inf)
    while len(picked) < min(k, len(sim)):
        score = sim.copy() if not picked else lam * sim - (1 - lam) * nearest
        score[picked] = -np.inf
        best = int(np.argmax(np.round(score, 12)))
        picked.append(best)
        nearest = np.maximum(nearest, vectors @ vectors[best])
    return picked


#: Most sections of one step inside a task, and most terms of windows that are weighed at once.
STEP_SECTIONS, STEP_TERMS = 2_000, 1_000_000
_SPANS = pa.list_(pa.struct([("sec_id", pa.string()), ("sent_idx", pa.int32()), ("sent_text", pa.string())]))
_SCHEMA = pa.schema([("doc_id", pa.string()), ("anchor_sec_id", pa.string()), ("gist_text", pa.string()), ("token_estimate", pa.int32()), ("source_spans", _SPANS)])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one range after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())


def _grams(counts: list[int], codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of one- and two-word terms, by text; counts: words of each text."""
    text = np.repeat(np.arange(len(counts)), counts)
    two = np.flatnonzero(text[1:] == text[:-1])
    size = words * (words + 1)
    keys, tf = np.unique(np.r_[text * size + codes, text[two] * size + words + codes[two] * words + codes[two + 1]], return_counts=True)
    return keys // size, keys % size, tf


def _picks(first: np.ndarray, last: np.ndarray, sentences: tuple, queries: tuple, size: int, k: int, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(window, sentence) of what mmr picks from each window of sentences first to last, all windows in step.

    sentences, queries: (text, term, tf) of the sentences and of the windows' queries. Weights are tf-idf of terms in at
    most 0.9 of a window's sentences, of unit length.
    """
    n = last - first
    offset = np.r_[0, np.cumsum(n)]
    text, term, tf = sentences
    low, high = np.searchsorted(text, first), np.searchsorted(text, last)
    at, win = _spread(low, high - low), np.repeat(np.arange(len(n)), high - low)
    own = offset[win] + text[at] - first[win]  # sentences of windows, numbered
    keys, back, df = np.unique(win * size + term[at], return_inverse=True, return_counts=True)
    of = keys // size
    idf = np.where((n[of] == 1) | (df <= 0.9 * n[of]), np.log((1 + n[of]) / (1 + df)) + 1, 0.0)
    v = tf[at] * idf[back]
    norm = np.sqrt(np.bincount(own, v * v, offset[-1]))
    v /= np.where(norm > 0, norm, 1)[own]
    asked = queries[0] * size + queries[1]
    there = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    hit = np.flatnonzero(keys[there] == asked) if len(keys) else np.array([], int)
    q = np.zeros(len(keys))
    q[there[hit]] = queries[2][hit] * idf[there[hit]]
    norm = np.sqrt(np.bincount(of, q * q, len(n)))
    q /= np.where(norm > 0, norm, 1)[of]
    sim = np.bincount(own, v * q[back], offset[-1])
    shared = (df >= 2)[back] & (v > 0)
    own, back, v = own[shared], back[shared], v[shared]
    window = np.repeat(np.arange(len(n)), n)
    nearest, free, picked = np.full(offset[-1], -np.inf), np.ones(offset[-1], bool), []
    for i in range(k):
        score = np.where(free, np.round(lam * sim - (1 - lam) * nearest if i else sim, 12), -np.inf)
        most = np.flatnonzero(free & (score == np.maximum.reduceat(score, offset[:-1])[window]))
        best = most[np.r_[True, window[most][1:] != window[most][:-1]]] if len(most) else most
        free[best] = False
        picked.append(best)
        chosen, x = np.zeros(offset[-1], bool), np.zeros(len(keys))
        chosen[best] = True
        mine = chosen[own]
        x[back[mine]] = v[mine]
        nearest = np.maximum(nearest, np.bincount(own, v * x[back], offset[-1]))
    out = np.sort(np.concatenate(picked))
    return window[out], first[window[out]] + out - offset[window[out]]


def _made(rows: pa.Table, anchors: np.ndarray, window: int, k: int, lam: float) -> pa.Table:
    """Gists of the anchors, numbers of rows; rows: (doc_id, pos, sec_id, heading, anchor, s), sorted by the first two."""
    docs, pos = rows["doc_id"], rows["pos"].to_numpy().astype(np.int64)
    doc = np.cumsum(np.r_[True, pc.not_equal(docs[1:], docs[:-1]).to_numpy()]) if len(rows) > 1 else np.array([1])
    span = int(pos.max() - pos.min()) + 2 * window + 2
    place = doc * span + pos - pos.min()
    low, high = np.searchsorted(place, place[anchors] - window, "left"), np.searchsorted(place, place[anchors] + window, "right")
    lists = rows["s"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    start = np.r_[0, np.cumsum(counts)]
    some = start[high] > start[low]
    anchors, low, high = anchors[some], low[some], high[some]
    if not len(anchors):
        return _SCHEMA.empty_table()
    sentences, ids, headings, names = lists.flatten().to_pylist(), rows["sec_id"].to_pylist(), [h or "" for h in rows["heading"].to_pylist()], docs.to_pylist()
    found = [_WORD.findall(x.lower()) for x in sentences]
    asked = [_WORD.findall(" ".join([ids[a], headings[a], *headings[b:c]]).lower()) for a, b, c in zip(anchors, low, high)]
    coded = pa.array([w for f in (found, asked) for x in f for w in x], pa.string()).dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    cut = sum(map(len, found))
    own, query = _grams([len(x) for x in found], codes[:cut], words), _grams([len(x) for x in asked], codes[cut:], words)
    first, last, row = start[low], start[high], np.repeat(np.arange(len(rows)), counts)
    terms = np.cumsum(np.searchsorted(own[0], last) - np.searchsorted(own[0], first))
    out: list[list] = [[] for _ in anchors]
    for step in np.split(np.arange(len(anchors)), np.flatnonzero(np.diff(terms // STEP_TERMS)) + 1):
        a, b = np.searchsorted(query[0], [step[0], step[-1] + 1])
        wins, picked = _picks(first[step], last[step], own, (query[0][a:b] - step[0], query[1][a:b], query[2][a:b]), words * (words + 1), k, lam)
        for w, s in zip((wins + step[0]).tolist(), picked.tolist()):
            out[w].append((ids[row[s]], s - int(start[row[s]]), sentences[s]))
    spans = [sorted(x) for x in out]
    texts = [" ".join(s for _, _, s in x) for x in spans]
    made = [[{"sec_id": a, "sent_idx": i, "sent_text": s} for a, i, s in x] for x in spans]
    return pa.table([pa.array([names[a] for a in anchors]), pa.array([ids[a] for a in anchors]), pa.array(texts), pa.array([len(x.split()) for x in texts], pa.int32()), pa.array(made, _SPANS)], schema=_SCHEMA)


def gists_of(near: DataFrame, window: int = 1, k: int = 6, lam: float = 0.7) -> DataFrame:
    """build_gists of sections (doc_id, sec_id, pos, heading, text, anchor): all that are in a window, and whether they are anchors.

    Sections pass in document order; held are those of whole documents in a step, of longer ones the last 2 * window.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(0, batch.num_rows, STEP_SECTIONS):
                new = pa.Table.from_batches([batch.slice(i, STEP_SECTIONS)])
                held = (new if held is None else pa.concat_tables([held, new])).combine_chunks()
                here, pos = pc.equal(held["doc_id"], held["doc_id"][-1]).to_numpy(), held["pos"].to_numpy()
                ready = ~here | (pos + window < pos[-1])
                anchor = held["anchor"].to_numpy()
                yield from _made(held, np.flatnonzero(anchor & ready), window, k, lam).to_batches()
                held = held.set_column(held.schema.get_field_index("anchor"), "anchor", pa.array(anchor & ~ready)).filter(pa.array(here & (pos >= pos[-1] - 2 * window)))
        if held is not None:
            yield from _made(held, np.flatnonzero(held["anchor"].to_numpy()), window, k, lam).to_batches()

    rows = near.sortWithinPartitions("doc_id", "pos").select("doc_id", "pos", "sec_id", "heading", "anchor", gist_sentences(F.col("text")).alias("s"))
    made = rows.mapInArrow(run, "doc_id string, anchor_sec_id string, gist_text string, token_estimate int, source_spans array<struct<sec_id: string, sent_idx: int, sent_text: string>>")
    return made.select("doc_id", "anchor_sec_id", F.lit(window).alias("window_size"), F.lit(k).alias("k_sentences"), F.lit(lam).alias("mmr_lambda"), "gist_text", "token_estimate", "source_spans")


def windows(anchors: DataFrame, positions: DataFrame, window: int = 1) -> DataFrame:
    """(doc_id, sec_id, pos, anchor): sections that are in a window of an anchor; positions: (doc_id, sec_id, pos)."""
    own = anchors.select("doc_id", "sec_id").distinct().join(positions, ["doc_id", "sec_id"]).select("doc_id", F.col("pos").alias("apos"))
    near = own.select("doc_id", F.explode(F.sequence(F.col("apos") - window, F.col("apos") + window)).alias("pos"), "apos")
    near = near.groupBy("doc_id", "pos").agg(F.max(F.col("pos") == F.col("apos")).alias("anchor"))
    return positions.join(near, ["doc_id", "pos"]).select("doc_id", "sec_id", "pos", "anchor")


def build_gists(sections: DataFrame, anchors: DataFrame, window: int = 1, k: int = 6, lam: float = 0.7) -> DataFrame:
    """(doc_id, anchor_sec_id, window_size, k_sentences, mmr_lambda, gist_text, token_estimate, source_spans).

    sections: (doc_id, sec_id, pos, heading, text), pos counting sections from 0; anchors: (doc_id, sec_id). Anchors
    without a section or a sentence get no gist; a window of one sentence gives that sentence.
    """
    near = windows(anchors, sections.select("doc_id", "sec_id", "pos"), window).select("doc_id", "sec_id", "anchor")
    return gists_of(sections.join(near, ["doc_id", "sec_id"]).repartition("doc_id"), window, k, lam)
