"""Sources and sinks. Every read has an explicit schema; a missing optional source is a typed empty frame."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators.structure import parse_xml

SECTIONS = "doc_id string, sec_id string, label string, heading string, text string, hierarchy_path array<string>, tokens int"
REFS = "doc_id string, sec_id string, heading string, explicit_refs array<string>, explicit_ref_spans array<struct<ref_text: string, raw_id: string, start: int, end: int, kind: string>>"
FLAT_REFS = "src_sec_id string, match_text string, match_kind string, span_start int, span_end int, norm_token string"
GISTS = "anchor_sec_id string, window_size int, k_sentences int, lambda double, gist_text string, token_estimate int, source_spans array<struct<sec_id: string, sent_idx: int, sent_text: string>>"
EVAL = "doc string, status string, path string, words int, mojibake string, cue_count int, cue_density double, coverage double, rougeL double, embed_sim double, redundancy double"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)) > 0


def optional(spark: SparkSession, path: str, schema: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """What read gives for path, or an empty frame of the schema where there is nothing."""
    return read(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str = SECTIONS, position: str | None = None) -> DataFrame:
    """JSON lines; lines that are no JSON fail the read. position: a column that keeps the order of lines within a file."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.withColumn(position, F.monotonically_increasing_id()) if position else df


def read_csv(spark: SparkSession, path: str, schema: str = FLAT_REFS) -> DataFrame:
    """CSV with a header line, in UTF-8 with or without a byte order mark; quoted fields may span lines."""
    return spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path, header=True, encoding="UTF-8", enforceSchema=True)


def read_terms_csv(spark: SparkSession, path: str) -> DataFrame:
    """(term) of a seed list."""
    return read_csv(spark, path, "term string").select(t.trim_blanks(F.regexp_replace("term", r"^\x{FEFF}", "")).alias("term")).filter("term <> ''")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of page text files that were extracted before; doc_id is the file name without its ending."""
    files = read_texts(spark, path)
    doc = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(doc.alias("doc_id"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def read_regulations(spark: SparkSession, path: str) -> DataFrame:
    """Sections of regulation XML files; doc_id from the file name (``CFR-2024-title6-vol1-part37`` gives ``cfr_6_37``)."""
    files = read_texts(spark, path)
    return parse_xml(files.select(document_id(F.col("path")).alias("doc_id"), F.col("text").alias("xml")))


def document_id(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    title, part = (F.regexp_extract(name, r"(?i)title-?(\d+).*?part-?(\d+)", i) for i in (1, 2))
    return F.when(title != "", F.concat_ws("_", F.lit("cfr"), title, part)).otherwise(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_")))


def volume_url(part_url: Column) -> Column:
    """(volume, part): the address of the volume that a part's address belongs to, and the part's number (null if none)."""
    part = F.regexp_extract(part_url, r"(?i)-part(\d+)", 1)
    return F.struct(F.regexp_replace(part_url, r"(?i)-part\d+", "").alias("volume"), F.when(part != "", part).alias("part"))


def read_pdf_lines(spark: SparkSession, path: str, backend: str = "pdfminer") -> DataFrame:
    """(doc_id, line_no, line, status) of PDF files by an installed extractor; status says what is missing or failed.

    Extractors: pdfminer, fitz, pdfplumber. Files are read as binary and extracted in parallel, one file a row.
    """
    if backend not in ("pdfminer", "fitz", "pdfplumber"):
        raise ValueError(f"unknown extractor {backend}")

    def lines_of(data: bytes) -> list[str]:
        import io

        if backend == "pdfminer":
            from pdfminer.high_level import extract_text

            return extract_text(io.BytesIO(data)).splitlines()
        if backend == "fitz":
            import fitz

            return [x for page in fitz.open(stream=data, filetype="pdf") for x in page.get_text("text").splitlines()]
        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [x for page in pdf.pages for x in (page.extract_text() or "").splitlines()]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for doc, data in zip(p["doc_id"], p["content"]):
                try:
                    got, status = lines_of(bytes(data)), "ok"
                except ImportError:
                    got, status = [], "import_error"
                except Exception as e:  # one unreadable file does not end the run; its row says why
                    got, status = [], f"error: {type(e).__name__}"
                yield pd.DataFrame({"doc_id": doc, "line_no": range(max(1, len(got))), "line": got or [None], "status": status})

    files = spark.read.format("binaryFile").load(path).select(document_id(F.col("path")).alias("doc_id"), "content")
    return files.mapInPandas(run, "doc_id string, line_no int, line string, status string")


def read_plan_ids(text: str) -> list[str]:
    """Ordered section ids of one plan text: a JSON array of strings or objects, or lines of JSON or plain ids.

    A text that is one JSON object gives no ids.
    """
    text = text.strip()
    if not text:
        return []
    try:
        items = json.loads(text)
    except ValueError:
        items = []
        for line in filter(None, map(str.strip, text.splitlines())):
            try:
                items.append(json.loads(line))
            except ValueError:
                items.append(line)
    else:
        items = items if isinstance(items, list) else []
    return [i["sec_id"] if isinstance(i, dict) else i for i in items if isinstance(i, str) or isinstance(i, dict) and "sec_id" in i]


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, sec_id) of plan files in any of the forms of read_plan_ids."""
    ids = F.pandas_udf(lambda s: s.map(read_plan_ids), "array<string>")
    return read_texts(spark, path).select("path", F.posexplode(ids("text")).alias("pos", "sec_id"))


def read_yaml(path: str) -> dict:
    """A small YAML file (a lexicon), read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if _exists(spark, p)), None)


# Sinks -----------------------------------------------------------------------------------------------------------


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """by: columns of the directory layout; rows of one value are brought together first, so files stay few."""
    w = df.repartition(*by).write.partitionBy(*by) if by else df.write
    w.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Appending keeps the first header's columns: the frame must have them in that order."""
    if mode == "append" and _exists(df.sparkSession, path):
        have = df.sparkSession.read.csv(path, header=True).columns
        if have and have != df.columns:
            raise ValueError(f"columns {df.columns} do not continue {have}")
    df.write.mode(mode).option("escape", '"').csv(path, header=True)


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(column).write.mode(mode).option("lineSep", "\n\f\n").text(path)


def write_yaml(data: dict, path: str) -> None:
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, allow_unicode=True, sort_keys=False)
