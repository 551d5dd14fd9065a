"""Encoding of texts with a public byte-level BPE vocabulary.

Merges of a pre-token are applied in rank order with a hierarchical-bitmap rank queue: one bucket per merge rank
holds the positions (in a linked list of parts) whose pair has that rank; three levels of 64-bit words say which
buckets are filled, so the next rank is three find-first-set steps away. An entry whose pair has changed since it was
queued is stale and skipped. The cost is linear in the number of merges, also for pre-tokens of millions of bytes.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: The pattern that splits a text before the merges of the byte_bpe files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most pre-tokens that a worker remembers with their ids, and the longest that it remembers.
REMEMBERED, REMEMBERED_BYTES = 200_000, 200


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files of this installation are; any other path can be given instead."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class RankQueue:
    """Positions by rank; ranks below 2**18."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[word >> 6] = self.mid.get(word >> 6, 0) | 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest filled rank and its positions, from left to right."""
        i = (self.top & -self.top).bit_length() - 1
        m = self.mid[i]
        word = i << 6 | (m & -m).bit_length() - 1
        bits = self.low[word]
        bit = bits & -bits
        rank = word << 6 | bit.bit_length() - 1
        self.low[word] = bits = bits ^ bit
        if not bits:
            self.mid[i] = m = m & ~(1 << (word & 63))
            if not m:
                self.top ^= 1 << i
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class BytePairEncoder:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, pair = RankQueue(), [-1] * n
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while queue.top:
            rank, positions = queue.pop()
            for i in positions:
                if pair[i] != rank:
                    continue  # stale: this pair was merged or changed
                j = after[i]
                parts[i] += parts[j]
                parts[j] = None
                pair[j] = -1
                after[i] = k = after[j]
                pair[i] = -1
                if k < n:
                    before[k] = i
                    r = ranks.get(parts[i] + parts[k])
                    if r is not None:
                        pair[i] = r
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = ranks.get(parts[h] + parts[i])
                    pair[h] = -1 if r is None else r
                    if r is not None:
                        queue.push(r, h)
        return [ranks[p] for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for m in self.split.finditer(text):
            piece = m[0]
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """The encoder of a vocabulary file; a worker reads each file once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder(path)
    return _ENCODERS[path]


def _run(path: str, counts_only: bool, keep: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(path))
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # long texts leave in small batches
                ids: list[np.ndarray] = []
                offsets, missing, size, start = [0], [], 0, at
                while at < batch.num_rows and size < 2_000_000:
                    text = batch.column(keep)[at].as_py()
                    got = np.asarray(enc.encode(text) if text else [], dtype=np.int32)
                    size += len(got)
                    offsets.append(size)
                    missing.append(text is None)
                    if not counts_only:
                        ids.append(got)
                    at += 1
                cols = [batch.column(i).slice(start, at - start) for i in range(keep)]
                if counts_only:
                    cols.append(pa.array(np.diff(offsets), pa.int64(), mask=np.array(missing)))
                else:
                    flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(missing)))
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:keep], name])

    return run


def _with(df: DataFrame, text: str, name: str, kind: str, path: str | None, counts_only: bool) -> DataFrame:
    keep = [c for c in df.columns if c not in (text, name)]
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    path = path or vocabulary_path()
    df.sparkSession.sparkContext.addFile(path)  # travels with the job
    return df.select(*keep, text).mapInArrow(_run(os.path.basename(path), counts_only, len(keep), name), ", ".join([*fields, f"`{name}` {kind}"]))


def with_token_ids(df: DataFrame, text: str, name: str = "ids", path: str | None = None) -> DataFrame:
    """df without text and with its token ids (array of int) as name; a column of that name is replaced.

    No special tokens: their strings in a text are ordinary text. An empty text has an empty list, a null text null.
    path: a vocabulary file of ranks (one base64 token and its rank per line) that the driver can read; it is sent to the workers as a file of the job.
    """
    return _with(df, text, name, "array<int>", path, False)


def with_token_counts(df: DataFrame, text: str, name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """As with_token_ids, with the number of tokens (bigint) only."""
    return _with(df, text, name, "bigint", path, True)
