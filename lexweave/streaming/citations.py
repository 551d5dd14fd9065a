"""Citations from a stream of sections, counted per document and window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.citations import all_refs


def citation_stream(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_id, loaded_at, ref) for each reference of each section; row-local, so stream and batch agree."""
    return sections.select("doc_id", "sec_id", "loaded_at", F.explode(all_refs(F.col("text"))).alias("ref"))


def citation_counts(sections: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(doc_id, from, n): references per document and window; rows more than ``late`` behind are dropped by the watermark."""
    refs = citation_stream(sections.withWatermark("loaded_at", late))
    return refs.groupBy("doc_id", F.window("loaded_at", window).alias("w")).agg(F.count("*").alias("n")).select("doc_id", F.col("w.start").alias("from"), "n")
