from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions.keys import cited_title, section_id
from lexweave.operators.orphans import orphan_counts, orphans, presence_intervals
from lexweave.operators.table_diff import PresenceBitmap, presence_bitmaps, table_diff


def test_section_id(spark):
    cases = {
        "§37.4": "§37.4", "§ 37.4(b)(2)(ii)": "§37.4", " §  37.4,": "§37.4", "Â§37.4": "§37.4", "�37.4": "§37.4", "37.4": "§37.4", "section 37.4": "§37.4", "Sec. 37.4": "§37.4",
        "§37 .4": "§37.4", "§37．4": "§37.4", "﻿§37.4​": "§37.4", "§§ 37.4": "§37.4", "§37.": None, "§": None, "": None, "n/a": None, "this part": None, None: None, "2CFR §7.12": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", section_id(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in got} == cases


def test_cited_title(spark):
    cases = {"2CFR part 7": "2CFR part 7", "§2CFRpart7": "2CFR part 7", "2 C.F.R. Part 7": "2CFR part 7", "2 cfr pt. 7": "2CFR part 7", "2CFR Â§7.12(a)": "2CFR §7.12", "2cfr §7.12": "2CFR §7.12", "ibid.": None, None: None, "§37.4": None}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", cited_title(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in got} == cases


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=6000), st.sets(st.integers(0, 65535), max_size=60))
def test_bitmaps(a, b):
    x, y = PresenceBitmap(np.array(sorted(a), dtype=int)), PresenceBitmap(np.array(sorted(b), dtype=int))
    assert set(x.and_not(y)) == a - b and set(x.intersect(y)) == a & b
    assert set(PresenceBitmap.from_bytes(x.to_bytes()).ordinals()) == a


def diff(spark, left, right, **kw):
    ddl = "k string, v int, x double, ts int, field int"
    got = table_diff(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), ["k"], "ts", {"x": 1}, **kw)
    return sorted(((r.k, r.field_name) for r in got.collect()), key=str)


def test_table_diff(spark):
    nan = float("nan")
    left = [("a", 1, 1.0, 1, 0), ("a", 1, 1.0, 1, 0), ("b", 1, nan, 1, 0), ("c", 1, 1.04, 1, 0), ("c", 9, 9.0, 0, 0), ("d", None, 1.0, 1, 0), (None, 1, 1.0, 1, 0), ("f", 1, -0.0, None, 0)]
    right = [("b", 1, None, 1, 0), ("c", 2, 1.0, 1, 0), ("d", 1, 1.0, 1, 0), ("e", 1, 1.0, 1, 0), (None, 1, 1.0, 1, 5), ("f", 1, 0.0, 1, 0)]
    want = [("a", "left_only"), ("c", "v"), ("d", "v"), ("e", "right_only"), (None, "field")]
    assert diff(spark, left, right) == sorted(want, key=str)
    assert diff(spark, left, right, keys_per_block=1) == sorted(want, key=str)
    assert diff(spark, [], right[:1]) == [("b", "right_only")] and diff(spark, [], []) == []


def test_presence_bitmaps(spark):
    got = presence_bitmaps(spark.range(1000).withColumnRenamed("id", "k"), ["k"], 4).collect()
    assert sum(r["keys"] for r in got) == 1000
    assert all(len(PresenceBitmap.from_bytes(bytes(r.bitmap)).ordinals()) == r["keys"] for r in got)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_orphans_heavy_and_light_agree(spark):
    rng = np.random.default_rng(3)
    refs = [(i, "hot" if i % 3 == 0 else f"k{rng.integers(40)}", day(int(rng.integers(100)))) for i in range(900)]
    refs += [(900, None, day(1)), (901, "k1", None)]
    rows = [("hot", day(20), day(40)), ("hot", day(30), day(50)), ("hot", day(80), None), ("k9", None, day(3)), (None, day(1), None)]
    rows += [(f"k{i}", day(i), day(i + 30) if i % 2 else None) for i in range(0, 40, 3)] * 2
    r = spark.createDataFrame(refs, "ref_id int, target string, seen_at timestamp")
    t = spark.createDataFrame(rows, "k string, a timestamp, b timestamp")
    want = {i for i, k, s in refs if k and s and not any(x == k and a and a <= s and (b is None or b > s) for x, a, b in rows)}
    iv = presence_intervals(t, F.col("k"), "a", "b")
    for kw in ({}, {"heavy_share": 5}, {"heavy_share": 5, "broadcast_intervals": 0}):
        assert {x.ref_id for x in orphans(r, iv, **kw).collect()} == want
    assert orphans(r.limit(0), iv).count() == 0
    assert orphans(r, iv.limit(0)).count() == 900


@pytest.mark.parametrize("options", [{}, {"heavy_share": 5}, {"heavy_share": 5, "broadcast_intervals": 0}])
def test_orphan_counts(spark, options):
    rng = np.random.default_rng(5)
    refs = [("f" if i % 4 else "g", "hot" if i % 3 == 0 else f"k{rng.integers(30)}", day(int(rng.integers(200)))) for i in range(700)]
    refs += [("f", None, day(1)), ("g", "k1", None)]
    rows = [(f"k{i}", day(i * 5), day(i * 5 + 70) if i % 2 else None) for i in range(0, 30, 2)] + [("hot", day(45), day(50)), ("hot", day(130), None)]
    iv = presence_intervals(spark.createDataFrame(rows, "k string, a timestamp, b timestamp"), F.col("k"), "a", "b")
    lost = [(f, k, s) for f, k, s in refs if k and s and not any(x == k and a <= s and (b is None or b > s) for x, a, b in rows)]
    want = {}
    for f, k, s in lost:
        want.setdefault((f, s.strftime("%Y-%m")), []).append(k)
    r = spark.createDataFrame(refs, "f string, target string, seen_at timestamp")
    got = {(x.f, x.month): (x.orphans, x.targets) for x in orphan_counts(r, iv, ["f"], **options).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert orphan_counts(r.limit(0), iv, ["f"]).count() == 0
