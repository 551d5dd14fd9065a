from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from lexweave.functions import text as t
from lexweave.operators import citations as c
from lexweave.operators import compare as cmp
from lexweave.operators import evaluate as ev
from lexweave.operators import gists as gs
from lexweave.operators import graph as g
from lexweave.operators import ranking as rk
from lexweave.operators import stitch as sti
from lexweave.operators import structure as st
from lexweave.operators import terms as tm
from lexweave.operators import vectors as vec


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see § 37.21.", ["§37.21"]),
        ("§§ 408.1000 through 408.1003", ["§408.1000", "§408.1001", "§408.1002", "§408.1003"]),
        ("20 CFR § 408.210", ["20CFR §408.210", "§408.210"]),
        ("6 CFR part 37", ["6CFR part 37"]),
        ("sections 115.10 and 115.11", ["§115.10"]),
        ("§ 37.11(c)(1)", ["§37.11(c)"]),
        ("", []),
        (None, []),
    ],
)
def test_refs(spark, text, want):
    assert one(spark, text, c.all_refs) == want


def test_range_guard_and_compat(spark):
    assert one(spark, "§§ 1.1 to 1.900", c.range_refs) == ["§1.1", "§1.900"]
    assert one(spark, "§§ 1.5 to 2.6", c.range_refs) == ["§1.5", "§2.6"]
    assert "§115.5-115" in one(spark, "§§ 115.5-115.7", c.all_refs)
    assert one(spark, "§§ 408.1000 through 408.1003", lambda x: c.range_refs(x, t.RANGE_COMPAT)) == []


def test_spans_slice_the_text(spark):
    text = "naïve 😀 § 37.21 and §§ 1.2–1.4; 20 CFR § 408.210, 6 CFR part 37; section 3.2"
    rows = c.ref_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, x string"), ["k"], "x").collect()
    assert rows and all(text[r.span_start : r.span_end] == r.ref_text for r in rows)
    assert {r.kind for r in rows} == {"range", "local", "inword", "cfr_sec", "cfr_part"}


def edges(spark, pairs, doc="d"):
    return spark.createDataFrame([(doc, a, b, 1) for a, b in pairs], "doc_id string, src_sec_id string, dst_sec_id string, span_count bigint")


def test_graph(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a")])
    assert {r.sec_id: (r.in_degree, r.out_degree) for r in g.degrees(e).collect()} == {"a": (2, 1), "b": (1, 1), "c": (1, 1), "d": (1, 1), "e": (0, 1)}
    assert {(r.sec_id, r.component) for r in g.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "a"), ("d", "d")}
    r = g.counts(e).first()
    assert (r.num_nodes, r.num_edges, r.density) == (5, 5, 5 / 20)
    assert g.clustering(e).first().avg_clustering == pytest.approx((1 / 3 + 1 + 1) / 5)


def test_pagerank_ways_agree(spark):
    rng = np.random.default_rng(1)
    e = edges(spark, {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 12, (25, 2))})
    a = {r.sec_id: r.pagerank for r in g.pagerank(e, tolerance=1e-12).collect()}
    b = {r.sec_id: r.pagerank for r in g.pagerank_rounds(e, rounds=12, tolerance=0).collect()}
    assert sum(a.values()) == pytest.approx(1) and a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=2e-2) for k in a)
    two = e.unionByName(edges(spark, [("n1", "n2"), ("n2", "n1"), ("n3", "n1")], "other"))  # each document stops in its own round
    a = {(r.doc_id, r.sec_id): r.pagerank for r in g.pagerank(two, tolerance=1e-2).collect()}
    b = {(r.doc_id, r.sec_id): r.pagerank for r in g.pagerank(two, tolerance=1e-2, max_task_edges=1).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert {(r.sec_id, r.component) for r in g.components(two, max_task_edges=1).filter("doc_id = 'other'").collect()} == {("n1", "n1"), ("n2", "n1"), ("n3", "n1")}
    assert sorted(map(tuple, g.components(two, max_task_edges=10).collect())) == sorted(map(tuple, g.components(two).collect()))
    node = {r.sec_id: r for r in g.node_table(two).filter("doc_id = 'other'").collect()}
    assert (node["n1"].in_degree, node["n1"].out_degree, node["n1"].in_span_strength) == (2, 1, 2)


def test_ref_score(spark):
    left = spark.createDataFrame([("d", "1", ["a", "b"]), ("d", "2", []), ("d", "3", ["x"])], "doc_id string, sec_id string, refs array<string>")
    right = spark.createDataFrame([("d", "1", ["b", "c"]), ("d", "3", [])], "doc_id string, sec_id string, refs array<string>")
    got = {r.sec_id: (r.overlap, r.precision, r.recall, r.f1, r.f1_strict) for r in c.ref_score(left, right).collect()}
    assert got == {"1": (1, 0.5, 0.5, 0.5, 0.5), "2": (0, 1.0, 1.0, 1.0, 1.0), "3": (0, 0.0, 0.0, 1.0, 0.0)}


def test_lines(spark):
    lines = ["preface", "§ 37.3", "Definitions.", "identi-", "fication card​", "12 | Page", "Source: x", "§ 37.4 Scope.", "body"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string")
    clean = st.dehyphenate_lines(st.clean_lines(df))
    got = [(r.sec_id, r.heading, r.text) for r in st.segment_lines(st.merge_wrapped_headers(clean)).orderBy("idx").collect()]
    assert got == [("§37.3", "Definitions.", "identification card"), ("§37.4", "Scope.", "body")]
    compat = [r.sec_id for r in st.segment_lines(st.merge_wrapped_headers(clean, compat=True)).collect()]
    assert compat == ["§37.4"]
    noise = spark.createDataFrame([("d", 0, "§ 1.1 A"), ("d", 1, "Source: x"), ("d", 2, "Source:x")], "doc_id string, line_no int, line string")
    assert [st.segment_lines(noise, compat=c).first().text for c in (False, True)] == ["", "Source: x"]


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_lines_of_a_document_in_many_blocks(spark, tasks):
    lines = [("d", i, ["§ 1.%d" % i, "Title", "a word- ", "broken-", "up", "§ 1.%d Scope" % i, "Source: x", "-"][(i * 5 + i // 9) % 8]) for i in range(200)] + [("e", 0, "x-"), ("e", 1, "y"), ("e", 2, None)]
    df = spark.createDataFrame(lines, "doc_id string, line_no int, line string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        joined = [(r.doc_id, r.line_no, r.line) for r in st.dehyphenate_lines(df.filter("line IS NOT NULL")).orderBy("doc_id", "line_no").collect()]
        merged = [(r.doc_id, r.line_no, r.line) for r in st.merge_wrapped_headers(df).orderBy("doc_id", "line_no").collect()]
        cut = [(r.doc_id, r.idx, r.text) for r in st.segment_lines(df).orderBy("doc_id", "idx").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = []
    for d, i, x in lines[:-1]:
        before = lines[i - 1][2] if d == "d" and i else lines[200][2] if (d, i) == ("e", 1) else ""
        if before.endswith("-") and x[0].isalpha():
            want[-1] = (*want[-1][:2], want[-1][2][:-1] + x)
        else:
            want.append((d, i, x))
    assert joined == want
    heads = [i for _, i, x in lines[:200] if x.startswith("§")]
    assert [c for c in cut] == [("d", n + 1, " ".join(" ".join(x.split()) for _, i, x in lines[h + 1 : ([*heads, 200])[n + 1]] if not x.startswith("Source:"))) for n, h in enumerate(heads)]
    plain = lambda x: x is not None and not x.startswith(("§", "Source:"))
    bare = lambda i: i >= 0 and lines[i][2] == "§ 1.%d" % i
    want = [("d", i, f"§ 1.{i} {lines[i + 1][2]}" if i < 199 and bare(i) and plain(lines[i + 1][2]) else x) for _, i, x in lines[:200] if not (bare(i - 1) and plain(x))]
    assert merged == want + [("e", 0, "x-"), ("e", 1, "y"), ("e", 2, None)]


def test_xml(spark):
    xml = """<PART><SUBPART><HD>Subpart A</HD><SECTION><SECTNO>§ 37.1</SECTNO><SUBJECT>Scope.</SUBJECT><P>Hello <E>it</E> x.</P><P>B</P></SECTION></SUBPART>
    <SECTION><SECTNO>§§ 37.5–37.6</SECTNO><SUBJECT>[Reserved]</SUBJECT></SECTION><SECTION><SECTNO>§ 37.1</SECTNO><SUBJECT>Again</SUBJECT></SECTION></PART>"""
    got = [tuple(r) for r in st.parse_xml(spark.createDataFrame([("d", xml)], "doc_id string, xml string")).orderBy("idx").collect()]
    assert got == [
        ("d", "§37.1", "§ 37.1", "Scope.", "Hello it x. B", ["Subpart A"], 4, 0),
        ("d", "§37.5", "§37.5", "[Reserved]", "", [], 1, 1),
        ("d", "§37.6", "§37.6", "[Reserved]", "", [], 1, 2),
    ]


def test_nested_and_broken_xml(spark):
    nested = """<ROOT><DIV5 TYPE="PART"><DIV6 TYPE="SUBPART" N="A"><HEAD>Subpart A—General</HEAD><DIV8 TYPE="SECTION"><HEAD>§ 37.1 Scope.</HEAD><DIV9><P>One&nbsp;&amp; two.</P></DIV9><P>identi-\nfied</P></DIV8></DIV6>
    <DIV8 TYPE="SUBSECTION"><SECTNO>§ 37.2-37.3</SECTNO><SUBJECT>Ends</SUBJECT>plain text</DIV8><SECTION><SECTNO>§ 9.9</SECTNO></SECTION></DIV5></ROOT>"""
    broken = "<A><SECTION><SECTNO>§ 1.1</SECTNO><P>kept</P></SECTION><SECTION><SECTNO>§ 1.2</SECTNO><P>cut <B"
    df = spark.createDataFrame([("n", nested), ("b", broken), ("e", ""), ("x", "no markup"), ("0", None)], "doc_id string, xml string")
    got = [tuple(r) for r in st.parse_xml(df).orderBy("doc_id", "idx").select("doc_id", "sec_id", "heading", "text", "hierarchy_path").collect()]
    assert got == [
        ("b", "§1.1", "", "kept", []),
        ("b", "§1.2", "", "cut", []),
        ("n", "§37.1", "§ 37.1 Scope.", "One\xa0& two. identified", ["Subpart A—General"]),
        ("n", "§37.2", "Ends", "§ 37.2-37.3 Ends plain text", []),
    ]


@given(st_.text("abcé ", max_size=14), st_.text("abcé ", max_size=14))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert cmp.edit_distance(a, b) == row[-1]


def test_alignment(spark):
    a = spark.createDataFrame([("d", str(i), 10) for i in range(4)], "doc_id string, sec_id string, size int")
    b = spark.createDataFrame([("d", "0", 5), ("d", "1", 10), ("d", "2", 20), ("d", "9", 1)], "doc_id string, sec_id string, size int")
    r = st.alignment_score(a, b).first()
    assert (r.overlap, r.only_left, r.only_right, r.precision, r.recall, r.ratio_median) == (3, 1, 1, 0.75, 0.75, 1.0)
    assert st.alignment_score(a.limit(0), b.limit(0)).count() == 0


def test_compare(spark):
    assert one(spark, "a", lambda x: cmp.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    s = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(cmp.similarity(F.col("a"), F.col("b")).alias("y")).first().y
    assert s("", "") == 100 and s("abcd", "abxd") == 75 and s("a", "") == 0


def test_text(spark):
    assert one(spark, "a b.\nc d", lambda x: t.word_cap(x, 4)) == "a b.\nc d"
    assert one(spark, "One two. Three four", lambda x: t.word_cap(x, 3)) == "One two."
    assert one(spark, "( § 3.1 )", t.citation_spacing) == "(§3.1)"
    assert one(spark, "Â§ 1  â€œxâ€\x9d", t.fix_garbled) == "§ 1 “x”"
    assert one(spark, "identi-\nfied  x\r\n\n\ny ", t.normalize_text) == "identified x\ny"
    assert one(spark, "", t.token_count) == 1


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("d", "1", ["x", "x", "y"]), ("d", "2", ["y", "z"]), ("d", "3", ["x", "z"])], "d string, r string, w array<string>")
    got = {(r.r, r.term): r.w for r in tm.tfidf(df, ["d"], ["r"], F.col("w"), max_df=1.0).collect()}
    idf = math.log(4 / 3) + 1
    x, y = (1 + math.log(2)) * idf, idf
    assert got["1", "x"] == pytest.approx(x / math.hypot(x, y)) and sum(v * v for (r, _), v in got.items() if r == "1") == pytest.approx(1)


def test_phrases(spark):
    assert one(spark, "The Reporting Requirements,", tm.normalize_phrase) == "reporting requirement"
    hits = lambda h, x, p: spark.createDataFrame([(h, x)], "h string, x string").select(rk.phrase_hits(F.col("h"), F.col("x"), p).alias("y")).first().y
    assert hits("On-the Record", None, ["on the record", "cord", "on the record"]) == 2 and hits(None, None, ["a"]) == 0 and hits("a", "b", []) == 0
    s = spark.createDataFrame([(1, "On-the Record", None), (2, None, "b, on the record"), (3, None, None)], "i int, h string, x string")
    lexicon = spark.createDataFrame([("on the record",), ("cord",), ("On the  record",), (None,), ("b",)], "phrase string")
    assert {r.i: r.hits for r in rk.lexicon_hits(s, ["i"], "h", "x", lexicon).collect()} == {1: 2, 2: 3, 3: 0}
    assert {r.hits for r in rk.lexicon_hits(s, ["i"], "h", "x", lexicon.limit(0)).collect()} == {0}


def test_terms_start_and_end_at_words(spark):
    assert one(spark, "3rd part- x3 a-b 'tis rock'n'roll- 9x-ray a- éa", lambda c: tm.term_list(c, 1, 1)) == ["x3", "a-b", "tis", "rock'n'roll", "ray", "éa"]


def test_minmax(spark):
    df = spark.createDataFrame([("d", 1.0, 5.0), ("d", 3.0, 5.0), ("d", None, 5.0)], "d string, a double, b double")
    assert sorted((r.a, r.b) for r in rk.minmax(df, ["d"], ["a", "b"]).collect()) == [(0.0, 0.0), (1 / 3, 0.0), (1.0, 0.0)]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("d", i, i, [float(x) for x in v[i]]) for i in range(60)], "doc_id string, sec_id int, idx int, vec array<double>")
    want = {}
    for i in range(0, 60, 20):
        s = v @ v[i]
        s[max(0, i - 1) : i + 2] = -9
        want[i] = list(np.argsort(-s, kind="stable")[:3])
    for block in (7, 4096):
        got = vec.global_knn(df, df.filter("sec_id % 20 = 0"), k=3, min_sim=-1, block=block).orderBy("src", "rank").collect()
        assert {i: [r.dst for r in got if r.src == i] for i in want} == want


def test_first_edge_wins_by_anchor(spark):
    e = [("d", "a", "b", 5, 0.9, 1, "implicit_knn_window"), ("d", "b", "a", 2, 0.8, 2, "implicit_knn_global"), ("d", "b", "c", 2, 0.7, 1, "implicit_knn_window")]
    df = spark.createDataFrame(e, "doc_id string, src string, dst string, anchor int, score double, rank int, method string")
    got = {(r.src, r.dst): (r.score, r.method) for r in vec.both_directions(df).collect()}
    assert got == {("b", "a"): (0.8, "implicit_knn_global"), ("a", "b"): (0.8, "implicit_knn_global_bidir"), ("b", "c"): (0.7, "implicit_knn_window"), ("c", "b"): (0.7, "implicit_knn_window_bidir")}


def test_gists(spark):
    text = "The first duty is to keep records safe. The second duty is to report losses early. Short one."
    s = spark.createDataFrame([("d", "§1.1", 0, "Duties", text), ("d", "§1.2", 1, "Only", "One sentence stands here alone."), ("d", "§1.5", 9, "None", None)], "doc_id string, sec_id string, pos int, heading string, text string")
    anchors = spark.createDataFrame([("d", "§1.1"), ("d", "§1.5"), ("d", "§9.9")], "doc_id string, sec_id string")
    rows = gs.build_gists(s, anchors, k=2).collect()
    assert len(rows) == 1 and len(rows[0].source_spans) == 2
    assert rows[0].gist_text == " ".join(x.sent_text for x in rows[0].source_spans) and rows[0].token_estimate == len(rows[0].gist_text.split())
    v = np.eye(3)
    assert gs.mmr(v, np.array([0.2, 0.9, 0.2]), 3, 0.7) == [1, 0, 2]


def test_stitch_and_budget(spark):
    anchors = spark.createDataFrame([("d", "a", 1), ("d", "b", 2)], "doc_id string, sec_id string, rank int")
    merged = spark.createDataFrame([("d", "a", "b", 1.0), ("d", "a", "x", 0.5), ("d", "b", "y", 0.1)], "doc_id string, src_sec_id string, dst_sec_id string, weight double")
    cen = spark.createDataFrame([("d", "x", 1.0)], "doc_id string, sec_id string, centrality double")
    plan = sti.stitch_plan(anchors, merged, cen)
    assert [(r.sec_id, r.role) for r in plan.orderBy("pos").collect()] == [("a", "anchor"), ("b", "neighbor"), ("x", "neighbor"), ("y", "neighbor")]
    texts = [("d", k, "h", " ".join(["w"] * n)) for k, n in (("p", 50), ("q", 60), ("r", 40), ("s", 20))]
    p = spark.createDataFrame([("d", i, x[1]) for i, x in enumerate(texts)], "doc_id string, pos int, sec_id string")
    none = spark.createDataFrame([], "doc_id string, anchor_sec_id string, gist_text string")
    r = sti.render(p, spark.createDataFrame(texts, "doc_id string, sec_id string, heading string, text string"), none, 100).first()
    assert (r.words, r.blocks) == (90, 2)


def test_measures(spark):
    assert one(spark, "a b c a b c", ev.trigram_redundancy) == pytest.approx(0.25)
    assert one(spark, None, ev.trigram_redundancy) == 0.0
    assert one(spark, "x (§ 3.1) (§4)", ev.cue_count) == 2
    plan = spark.createDataFrame([("d", "§37.1"), ("d", "§37.2")], "doc_id string, sec_id string")
    r = ev.coverage(plan, spark.createDataFrame([("d", "see § 37.11 now")], "doc_id string, summary_text string")).first()
    assert (r.coverage, r.coverage_strict) == (50.0, 0.0)
    assert [ev.porter_stem(w) for w in ("caresses", "relational", "hopping", "agreed", "happy", "the")] == ["caress", "relat", "hop", "agre", "happi", "the"]
    assert ev.rouge_l("the cats sat", "the cat sat down") == pytest.approx(6 / 7) and ev.rouge_l("", "x") == 0 and ev.rouge_l(None, None) == 0


def test_encode_takes_whole_texts(spark):
    model = lambda texts: np.array([[t.count("a") + 1e-6, t.count("b")] for t in texts])
    rows = [(0, "a" * 8000 + "b" * 8000 + "b" * 4000), (1, "ab"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.vec for r in vec.encode(df, "t", model).collect()}
    assert got[0] == pytest.approx(np.array([8, 12]) / np.hypot(8, 12), abs=1e-5)
    assert got[1] == pytest.approx([0.5**0.5] * 2, abs=1e-5) and got[2] == got[3] == pytest.approx([1, 0])
    assert {r.i: r.vec for r in vec.encode(df, "t", model, compat=True).collect()}[0] == pytest.approx([1, 0], abs=1e-5)
