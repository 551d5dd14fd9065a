"""Structuring of sources into sections: filters, dedupe, line streams, alignment of two parses."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lexweave.functions import text as t
from lexweave.session import cut


def filter_by_part(sections: DataFrame, part: Column) -> DataFrame:
    """Sections whose label is of the given part."""
    return sections.filter(F.regexp_extract("label", rf"§{t.WS}*([0-9]+)", 1) == part)


def dedupe_first(sections: DataFrame, order: list[str]) -> DataFrame:
    """Of every (doc_id, sec_id) the first row by order (aggregated before the shuffle, so repeated rows do not pile up)."""
    rest = [c for c in sections.columns if c not in ("doc_id", "sec_id", *order)]
    best = sections.groupBy("doc_id", "sec_id").agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select("doc_id", "sec_id", "b.*")


def dedupe_longest(sections: DataFrame, order: list[str]) -> DataFrame:
    """Of every (doc_id, sec_id) the row with the longest text, the first by order among equals; idx is the first seen."""
    rest = [c for c in sections.columns if c not in ("doc_id", "sec_id", "idx", *order)]
    size = -F.coalesce(F.length("text"), F.lit(0))
    best = sections.groupBy("doc_id", "sec_id").agg(F.min(F.struct(size.alias("_size"), *order, *rest)).alias("b"), F.min("idx").alias("idx"))
    return best.select("doc_id", "sec_id", "idx", *[F.col("b")[c].alias(c) for c in dict.fromkeys([*order, *rest]) if c != "idx"])


def reserved_ids(sectno: Column, heading: Column) -> Column:
    """Ids of a reserved range such as ``§§ 37.5–37.9`` headed ``[Reserved]``; empty if it is none."""
    rx = rf"([0-9]{{1,3}}\.[0-9]{{1,3}}){t.WS}*[–-]{t.WS}*([0-9]{{1,3}}\.[0-9]{{1,3}})"
    a, b = F.regexp_extract(sectno, rx, 1), F.regexp_extract(sectno, rx, 2)
    same = F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)
    span = F.substring_index(b, ".", -1).try_cast("int") - F.substring_index(a, ".", -1).try_cast("int")
    ok = t.trim_blanks(sectno).startswith("§§") & F.lower(t.trim_blanks(heading)).startswith("[reserved") & (a != "") & same & span.between(0, 500)
    return F.when(ok, F.transform(t.expand_range(F.when(ok, a), F.when(ok, b)), lambda x: F.concat(F.lit("§"), x))).otherwise(F.array().cast("array<string>"))


#: Elements that may be sections or subparts.
LEVELS = ("SECTION", "SUBPART", "DIV3", "DIV4", "DIV5", "DIV6", "DIV7", "DIV8")
_ENTITY = re.compile(r"&(?!amp;|lt;|gt;|quot;|apos;|#)(\w+);")


class _Tree(ET.TreeBuilder):
    """Builds a tree of what was read so far: elements that an error leaves open are closed."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []

    def start(self, tag, attrs):
        self.open.append(tag)
        return super().start(tag, attrs)

    def end(self, tag):
        self.open.pop()
        return super().end(tag)


def _tree(xml: str) -> ET.Element | None:
    tree = _Tree()
    parser = ET.XMLParser(target=tree)
    try:
        parser.feed(_ENTITY.sub(lambda m: html.unescape(m[0]).replace("&", "&amp;"), xml))
        return parser.close()
    except ET.ParseError:
        if not tree.open:
            return None
        while tree.open:
            tree.end(tree.open[-1])
        return tree.close()


def _said(node: ET.Element | None) -> str:
    return " ".join(s for x in ([] if node is None else node.itertext()) if (s := x.strip()))


def _section_nodes(xml: str) -> list[tuple[str, str, str, str]]:
    """(number, heading, text, subpart) of the section elements of one document, in order.

    Sections are elements of LEVELS whose TYPE says so; without any, all SECTION elements. subpart: title of the
    innermost subpart around it, an element whose TYPE says so or a SUBPART.
    """
    root = _tree(xml)
    found: list[tuple[bool, ET.Element, str]] = []

    def walk(top: ET.Element) -> None:
        stack = [(top, "")]
        while stack:
            node, subpart = stack.pop()
            kind = node.get("TYPE", "").lower()
            if node.tag in LEVELS and "section" in kind:
                found.append((True, node, subpart))
            elif node.tag == "SECTION":
                found.append((False, node, subpart))
            if node.tag == "SUBPART" or node.tag in LEVELS and "subpart" in kind:
                title = next((x for x in node.iter() if x.tag in ("SUBJECT", "HEAD", "HD")), None)
                subpart = "Subpart" if title is None else _said(title)
            stack.extend((child, subpart) for child in reversed(node))

    if root is not None:
        walk(root)
    typed = any(t for t, _, _ in found)
    out = []
    for is_typed, node, subpart in found:
        if is_typed == typed:
            inner = [x for x in node.iter() if x is not node]
            number = next((x for x in inner if "SECTNO" in x.tag.upper()), None)
            heading = next((x for x in inner if "SUBJECT" in x.tag.upper()), None)
            heading = next((x for x in inner if x.tag == "HEAD"), None) if heading is None else heading
            body = [x for x in inner if x.tag == "P"]
            text = " ".join(s for x in (body or [node]) if (s := _said(x)))
            out.append((_said(number), _said(heading), text, subpart))
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(d, i, *x) for d, xml in zip(*(c.to_pylist() for c in batch.columns)) for i, x in enumerate(_section_nodes(xml or ""))]
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pos", "sectno", "heading", "text", "subpart"])


def parse_xml(xml: DataFrame) -> DataFrame:
    """Sections (doc_id, sec_id, label, heading, text, hierarchy_path, tokens, idx) of regulation XML (doc_id, xml).

    Elements may be nested; what follows an error in the markup is left out. Ids come from SECTNO, else from the
    heading, else are ``§UNKNOWN``; reserved ranges give one row per id; of equal ids the first one stays. A null or
    empty xml gives no row.
    """
    schema = "doc_id string, pos int, sectno string, heading string, text string, subpart string"
    found = xml.select(F.col("doc_id").cast("string"), "xml").mapInArrow(_parsed, schema)
    found = found.withColumns({"sectno": t.normalize_text(F.col("sectno")), "heading": t.normalize_text(F.col("heading"))})
    rx = r"(\d{1,3}\.\d{1,3}[A-Za-z0-9\-]*(?:\([a-z0-9]+\))?)"
    number = F.regexp_extract("sectno", rx, 1)
    number = F.when(number == "", F.regexp_extract("heading", rx, 1)).otherwise(number)
    number = F.element_at(F.split(number, rf"{t.WS}*[-–]{t.WS}*"), 1)
    reserved = reserved_ids(F.col("sectno"), F.col("heading"))
    plain = F.array(F.concat(F.lit("§"), F.when(number == "", "UNKNOWN").otherwise(number)))
    rows = found.select("*", F.size(reserved).alias("_r"), F.posexplode(F.when(F.size(reserved) > 0, reserved).otherwise(plain)).alias("_k", "sec_id"))
    none = F.col("_r") > 0
    rows = rows.select(
        "doc_id", "sec_id", F.struct("pos", "_k").alias("idx"),
        F.when(none, F.col("sec_id")).otherwise(F.regexp_replace("sec_id", "^§", "§ ")).alias("label"),
        F.when(none, "[Reserved]").otherwise(F.col("heading")).alias("heading"),
        F.when(none, "").otherwise(t.normalize_text(F.col("text"))).alias("text"), "subpart",
    )
    out = dedupe_first(rows, ["idx"])
    order = W.Window.partitionBy("doc_id").orderBy("idx")
    return out.select(
        "doc_id", "sec_id", "label", "heading", "text", F.when(F.col("subpart") != "", F.array("subpart")).otherwise(F.array().cast("array<string>")).alias("hierarchy_path"),
        t.token_count(F.col("text")).alias("tokens"), (F.row_number().over(order) - 1).alias("idx"),
    )


# Lines -----------------------------------------------------------------------------------------------------------


def clean_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) without zero-width ends, repeated blanks, empty lines, page junk."""
    line = t.squeeze_blanks(F.regexp_replace("line", r"\x{200B}+$", ""))
    return lines.select("doc_id", "line_no", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(t.PAGE_JUNK))


def _blocks(lines: DataFrame) -> DataFrame:
    """lines with ``_block``: a range of (doc_id, line_no) that one task holds, however many lines a document has.

    The ranges are fixed by a checkpoint, so what is summed per block stays true when a task runs again.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(lines.repartitionByRange(tasks, "doc_id", "line_no").withColumn("_block", F.spark_partition_id()))


def _inside() -> W.WindowSpec:
    return W.Window.partitionBy("doc_id", "_block").orderBy("line_no")


def _of_blocks() -> W.WindowSpec:
    """Over the blocks of a document, of which there are as many as tasks at most."""
    return W.Window.partitionBy("doc_id").orderBy("_block")


def _neighbours(blocked: DataFrame) -> DataFrame:
    """blocked with ``_prev`` and ``_next``: the lines before and after, across blocks too; null at the document's ends."""
    one = F.struct("line")
    ends = blocked.groupBy("doc_id", "_block").agg(F.min_by(one, "line_no").alias("_first"), F.max_by(one, "line_no").alias("_last"))
    ends = ends.select("doc_id", "_block", F.lag("_last").over(_of_blocks()).alias("_before"), F.lead("_first").over(_of_blocks()).alias("_after"))
    found = blocked.join(ends, ["doc_id", "_block"])
    found = found.withColumns({"_prev": F.coalesce(F.lag(one).over(_inside()), "_before")["line"], "_next": F.coalesce(F.lead(one).over(_inside()), "_after")["line"]})
    return found.drop("_before", "_after")


def _running(blocked: DataFrame, flag: Column, name: str) -> DataFrame:
    """blocked with the number of flagged lines up to each one, counted per block and carried from block to block."""
    marked = blocked.withColumn("_flag", flag.cast("int"))
    sums = marked.groupBy("doc_id", "_block").agg(F.sum("_flag").alias("_n"))
    carried = F.coalesce(F.sum("_n").over(_of_blocks().rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("doc_id", "_block", carried.alias("_carried"))
    return marked.join(sums, ["doc_id", "_block"]).withColumn(name, F.col("_carried") + F.sum("_flag").over(_inside())).drop("_carried", "_flag")


def dehyphenate_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): a line that ends in a hyphen is joined with the next one if that starts with a letter or digit."""
    joins = F.coalesce(F.col("_prev").endswith("-") & F.col("line").rlike(r"^[\p{L}\p{N}]"), F.lit(False))
    marked = _neighbours(_blocks(lines.select("doc_id", "line_no", "line"))).withColumn("_joins", joins)
    runs = _running(marked, ~F.col("_joins"), "_run")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "_joins", "line")))
    text = F.aggregate(parts, F.lit(""), lambda s, x: F.when(x["_joins"], F.concat(F.regexp_replace(s, "-$", ""), x["line"])).otherwise(x["line"]))
    return runs.groupBy("doc_id", "_run").agg(F.min("line_no").alias("line_no"), text.alias("line")).drop("_run")


def merge_wrapped_headers(lines: DataFrame, compat: bool = False) -> DataFrame:
    """A header line without title takes a plain next line as its title.

    compat drops the section sign in doing so, and takes for noise only lines whose label a word follows at once.
    """
    noise = t.NOISE_LINE_COMPAT if compat else t.NOISE_LINE

    def bare(c: Column) -> Column:
        return F.coalesce(c.rlike(t.HEADER_LINE) & (F.regexp_extract(c, t.HEADER_LINE, 2) == ""), F.lit(False))

    def plain(c: Column) -> Column:
        return F.coalesce(~c.rlike(t.HEADER_LINE) & ~c.rlike(t.PAGE_JUNK) & ~c.rlike(noise), F.lit(False))

    marked = _neighbours(_blocks(lines.select("doc_id", "line_no", "line")))
    line = F.col("line")
    joined = F.concat(F.lit("" if compat else "§ "), F.regexp_extract("line", t.HEADER_LINE, 1), F.lit(" "), F.col("_next"))
    kept = marked.filter(~(bare(F.col("_prev")) & plain(line)))
    return kept.select("doc_id", "line_no", F.when(bare(line) & plain(F.col("_next")), joined).otherwise(line).alias("line"))


def segment_lines(lines: DataFrame, compat: bool = False) -> DataFrame:
    """(doc_id, idx, sec_id, heading, text, tokens): lines gathered under their header; lines before the first one are dropped.

    Noise lines are dropped; compat: see merge_wrapped_headers.
    """
    header = F.col("line").rlike(t.HEADER_LINE)
    rows = _running(_blocks(lines.select("doc_id", "line_no", "line").filter("line IS NOT NULL")), header, "idx").withColumn("_h", header)
    rows = rows.filter((F.col("idx") > 0) & (F.col("_h") | ~F.col("line").rlike(t.NOISE_LINE_COMPAT if compat else t.NOISE_LINE)))
    head = F.max(F.when(F.col("_h"), F.col("line")))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("line_no", "line")))), lambda x: x["line"])
    out = rows.groupBy("doc_id", "idx").agg(head.alias("_head"), t.squeeze_blanks(F.array_join(body, " ")).alias("text"))
    return out.select("doc_id", "idx", F.concat(F.lit("§"), F.regexp_extract("_head", t.HEADER_LINE, 1)).alias("sec_id"), F.trim(F.regexp_extract("_head", t.HEADER_LINE, 2)).alias("heading"), "text", t.token_count(F.col("text")).alias("tokens"))


# Alignment of two parses -----------------------------------------------------------------------------------------


def keep_known(candidate: DataFrame, truth: DataFrame) -> DataFrame:
    return candidate.join(truth.select("doc_id", "sec_id").distinct(), ["doc_id", "sec_id"], "left_semi")


#: Signs around the word, and what is left of a text that only says that it is reserved.
RESERVED_SIGNS = r"[\s\[\]\.\-–—]+"
RESERVED_WORDS = ["reserved", "reserved;", "reserved:"]


def reserved_like() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(F.lower(text), RESERVED_SIGNS, "")
    short = (F.length(t.trim_blanks(text)) <= 60) & F.lower(text).contains("reserved")
    return F.lower(F.trim(F.coalesce("heading", F.lit("")))).startswith("[reserved") | short | bare.isin(RESERVED_WORDS)


def reserved_missing(truth: DataFrame, candidate: DataFrame) -> DataFrame:
    """Reserved-like sections of truth that candidate lacks, as rows to add: (doc_id, sec_id, heading, text, tokens)."""
    missing = truth.join(candidate.select("doc_id", "sec_id").distinct(), ["doc_id", "sec_id"], "left_anti").filter(reserved_like())
    heading = F.when(F.coalesce("heading", F.lit("")) == "", "[Reserved]").otherwise(F.col("heading"))
    return missing.select("doc_id", "sec_id", heading.alias("heading"), F.lit("").alias("text"), F.lit(1).alias("tokens"))


def alignment_score(truth: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per document: overlap, only_left, only_right, precision, recall, f1, median and IQR of the length ratio.

    truth and candidate: (doc_id, sec_id, size), one row per section. Quantiles are those at index n/2, n/4, 3n/4 of the
    sorted ratios of common sections.
    """
    j = truth.withColumnRenamed("size", "a").join(candidate.withColumnRenamed("size", "b"), ["doc_id", "sec_id"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    g = j.groupBy("doc_id").agg(
        F.sum(both.cast("int")).alias("overlap"), F.sum(F.col("b").isNull().cast("int")).alias("only_left"), F.sum(F.col("a").isNull().cast("int")).alias("only_right"),
        F.array_sort(F.collect_list(F.when(both, F.col("b") / F.greatest(F.lit(1), F.col("a"))))).alias("_r"),
    )
    p = F.when(F.col("overlap") + F.col("only_right") > 0, F.col("overlap") / (F.col("overlap") + F.col("only_right"))).otherwise(0.0)
    r = F.when(F.col("overlap") + F.col("only_left") > 0, F.col("overlap") / (F.col("overlap") + F.col("only_left"))).otherwise(0.0)
    at = lambda k: F.try_element_at("_r", (F.floor(F.size("_r") * k / 4) + 1).cast("int"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select("doc_id", "overlap", "only_left", "only_right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(at(F.lit(2)), 6).alias("ratio_median"), F.round(at(F.lit(3)) - at(F.lit(1)), 6).alias("ratio_iqr"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """Per document the candidate with the best f1, the preferred one among equals, then the faster one."""
    order = F.struct((-F.col("f1")).alias("f"), (~F.col("preferred")).alias("p"), F.coalesce("runtime_s", F.lit(1e9)).alias("t"), "backend")
    best = scores.groupBy("doc_id").agg(F.min(order).alias("b"))
    return best.select("doc_id", "b.backend", (-F.col("b.f")).alias("f1"))
