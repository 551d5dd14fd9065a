from __future__ import annotations

import pytest

import __spark_entry__
from lexweave.sources import io
from lexweave.streaming.citations import citation_counts, citation_stream


def test_plan_ids():
    assert io.read_plan_ids('[{"sec_id": "§1.1"}, "§1.2"]') == ["§1.1", "§1.2"]
    assert io.read_plan_ids('{"sec_id": "§1.1"}\n"§1.2"\n§1.3\n\n') == ["§1.1", "§1.2", "§1.3"]
    assert io.read_plan_ids('{"sec_id": "§1.1"}') == [] and io.read_plan_ids("") == []


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("d", "§1.1", "§ 1.1", "H", "t x", ["a"], 2)], io.SECTIONS)
    io.write_jsonl(df, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j")).collect() == df.collect()
    io.write_parquet(df, str(tmp_path / "p"), ["doc_id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    flat = spark.createDataFrame([("§1.1", 'a "q", b', "single", 1, 2, "§1.2")], io.FLAT_REFS)
    io.write_csv(flat, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c")).collect() == flat.collect()
    with pytest.raises(ValueError):
        io.write_csv(flat.select("norm_token"), str(tmp_path / "c"), mode="append")
    assert io.optional(spark, str(tmp_path / "none"), io.EVAL, spark.read.csv).columns[0] == "doc"
    (tmp_path / "seeds.csv").write_text("﻿term\nScope\n", encoding="utf-8")
    assert [r.term for r in io.read_terms_csv(spark, str(tmp_path / "seeds.csv")).collect()] == ["Scope"]
    (tmp_path / "CFR-2024-title6-vol1-part37.xml").write_text("<R><SECTION><SECTNO>§ 37.1</SECTNO><SUBJECT>S</SUBJECT><P>x</P></SECTION></R>", encoding="utf-8")
    r = io.read_regulations(spark, str(tmp_path / "CFR-2024-title6-vol1-part37.xml")).first()
    assert (r.doc_id, r.sec_id) == ("cfr_6_37", "§37.1")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 broken")
    assert io.read_pdf_lines(spark, str(tmp_path / "x.pdf")).first().status != "ok"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/sections.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = citation_stream(stream).writeStream.format("memory").queryName("refs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    assert q.awaitTermination(120)
    assert spark.table("refs").count() == citation_stream(batch).count()
    assert citation_counts(batch).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and {"p6_found", "p7_found"} <= set(q)
