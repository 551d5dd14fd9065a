"""Differences between two copies of a table.

Every key gets an ordinal that both copies share. Keys are hashed into blocks of bounded size; inside a block
the ordinal is the rank of the key. Each side then has one compressed presence bitmap per block. AND-NOT of the
two bitmaps gives the ordinals missing on a side; their AND selects the rows that are compared column by column
after both sides were put in ordinal order. Blocks are independent, so the work is spread over the cluster and no
task sees more than one block, however the keys are distributed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Expected keys of one block; hashing keeps every block close to it.
KEYS_PER_BLOCK = 16_384


class PresenceBitmap:
    """A set of ordinals below 2**16, kept as a sorted array while that is smaller and as bits otherwise."""

    ARRAY_LIMIT = 4_096

    def __init__(self, ordinals: np.ndarray) -> None:
        o = np.unique(np.asarray(ordinals, dtype=np.int64))
        self.array = o.astype(np.uint16) if len(o) <= self.ARRAY_LIMIT else None
        self.bits = None if self.array is not None else self._pack(o)

    @staticmethod
    def _pack(o: np.ndarray) -> np.ndarray:
        flags = np.zeros(1 << 16, dtype=np.uint8)
        flags[o] = 1
        return np.packbits(flags)

    def _dense(self) -> np.ndarray:
        return self.bits if self.bits is not None else self._pack(self.array.astype(np.int64))

    def ordinals(self) -> np.ndarray:
        return self.array.astype(np.int64) if self.array is not None else np.flatnonzero(np.unpackbits(self.bits))

    def and_not(self, other: PresenceBitmap) -> np.ndarray:
        """Ordinals here and not in other."""
        return np.flatnonzero(np.unpackbits(self._dense() & ~other._dense()))

    def intersect(self, other: PresenceBitmap) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self._dense() & other._dense()))

    def to_bytes(self) -> bytes:
        """Compressed form, for storing or sending."""
        return b"A" + self.array.tobytes() if self.array is not None else b"B" + zlib.compress(self.bits.tobytes(), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> PresenceBitmap:
        raw = data[1:] if data[:1] == b"A" else zlib.decompress(data[1:])
        return cls(np.frombuffer(raw, dtype=np.uint16).astype(np.int64) if data[:1] == b"A" else np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8))))


def _canonical(c: Column, kind: T.DataType, scale: int | None) -> Column:
    """c as text that is equal exactly where the values count as equal; NaN becomes null, -0.0 becomes 0.0."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(c), c)
        v = F.round(v, scale) if scale is not None else v
        return (v + F.lit(0.0)).cast("string")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def latest_rows(df: DataFrame, keys: list[str], version: str | None, fields: list[str]) -> DataFrame:
    """Of each key the row with the greatest version; ties go to the greatest values, so the result is defined.

    A null version counts as oldest. Repeated rows collapse before the shuffle (partial aggregation), so a key
    that holds a third of all rows costs no more than any other.
    """
    order = [F.col(version)] if version else []
    best = F.max(F.struct(*order, *[F.col(f) for f in fields]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col("_best")[f].alias(f) for f in fields])


def _compare(keys: list[str], fields: list[str]):
    names = np.array(fields, dtype=object)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        side, ordinal = block["_side"].to_numpy(), block["_ordinal"].to_numpy().astype(np.int64)
        left, right = PresenceBitmap(ordinal[side == 0]), PresenceBitmap(ordinal[side == 1])
        place = np.full((2, int(ordinal.max()) + 1), -1, dtype=np.int64)
        place[side, ordinal] = np.arange(len(block))
        out_at, out_name = [], []
        for only, name, s in ((left.and_not(right), "left_only", 0), (right.and_not(left), "right_only", 1)):
            out_at.append(place[s, only])
            out_name.append(np.full(len(only), name, dtype=object))
        both = left.intersect(right)
        a, b = place[0, both], place[1, both]
        for f in names:
            x = block[f].to_numpy(dtype=object)
            xa, xb = x[a], x[b]
            na, nb = pd.isna(xa), pd.isna(xb)
            differ = (na != nb) | (~na & ~nb & (xa != xb))
            out_at.append(a[differ])
            out_name.append(np.full(int(differ.sum()), f, dtype=object))
        at = np.concatenate(out_at)
        out = block[keys].iloc[at].reset_index(drop=True)
        out["field_name"] = np.concatenate(out_name)
        return out

    return run


def table_diff(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    version: str | None = None,
    scales: dict[str, int] | None = None,
    fields: list[str] | None = None,
    keys_per_block: int = KEYS_PER_BLOCK,
) -> DataFrame:
    """Rows (keys..., field_name): a field that differs, ``left_only`` or ``right_only``.

    keys: columns of both sides; a null key is a key like any other. version: of each key only the row with the
    greatest version counts (without it, the greatest row). fields: the compared columns, by default all that both
    sides have besides keys and version. scales: decimals at which doubles are compared. NaN equals null; null
    differs from any value. Repeated rows count once; empty tables give every key of the other side. Columns that
    only one side has are ignored. A key column may not be called ``field_name``, ``_side`` or ``_ordinal``.
    """
    kinds = {f.name: f.dataType for f in left.schema.fields}
    fields = fields or [c for c in left.columns if c in right.columns and c not in keys and c != version]
    scales = scales or {}

    def side(df: DataFrame, n: int) -> DataFrame:
        df = df.select(
            *[F.col(k) for k in keys],
            *([F.col(version)] if version else []),
            *[_canonical(F.col(f), kinds[f], scales.get(f)).alias(f) for f in fields],
        )
        if not fields:
            return df.select(*keys).distinct().withColumn("_side", F.lit(n))
        return latest_rows(df, keys, version, fields).withColumn("_side", F.lit(n))

    rows = left.count() + right.count()
    blocks = max(1, math.ceil(rows / keys_per_block))
    both = side(left, 0).unionByName(side(right, 1)).withColumn("_block", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(blocks)))
    rank = F.dense_rank().over(W.Window.partitionBy("_block").orderBy(*[F.col(k).asc_nulls_first() for k in keys]))
    ordered = both.withColumn("_ordinal", (rank - 1).cast("int"))
    schema = T.StructType([*[f for f in ordered.schema.fields if f.name in keys], T.StructField("field_name", T.StringType())])
    return ordered.groupBy("_block").applyInPandas(_compare(keys, fields), schema)


def presence_bitmaps(df: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """(block, keys, bitmap): the compressed presence bitmap of each block's keys, for keeping beside a table."""
    ordered = df.select(*keys).distinct().withColumn("block", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(blocks)))
    rank = F.row_number().over(W.Window.partitionBy("block").orderBy(*[F.col(k) for k in keys])) - 1

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"block": p["block"], "keys": [len(o) for o in p["o"]], "bitmap": [PresenceBitmap(np.asarray(o)).to_bytes() for o in p["o"]]})

    grouped = ordered.withColumn("o", rank.cast("int")).groupBy("block").agg(F.collect_list("o").alias("o"))
    return grouped.mapInPandas(build, "block bigint, keys bigint, bitmap binary")
