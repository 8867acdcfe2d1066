from __future__ import annotations

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.functions import parsers, text
from loomfold.operators import answers, evaluation, pages, relational, retrieval, state
from loomfold.operators.graph import rule_holds
from loomfold.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "ok", "at"),
    [("3(3-0-6)", True, None), ("30(30-30-30)", True, None), ("31(3-0-6)", False, 0), ("3(31-0-6)", False, 2), ("3(3-0-40)", False, 6), ("3(3-0", False, 5), ("3(3-0-6)x", False, 8), ("", False, 0), ("x", False, 0), ("3 (3-0-6)", False, 1)],
)
def test_credits(spark, raw, ok, at):
    r = one(spark, parsers.credits(F.lit(raw)))
    assert (r.ok, r.error_index) == (ok, at)
    if ok:
        assert one(spark, parsers.print_credits(F.lit(r.total), F.lit(r.lecture), F.lit(r.lab), F.lit(r.self_study))) == raw
    assert one(spark, parsers.credits(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    ("raw", "canonical", "depth"),
    [
        ("", "", 0), ("ไม่มี", "", 0), ("06016101", "06016101", 0), ("A and B or C", "A และ B หรือ C", 2), ("(A or B) and C", "(A หรือ B) และ C", 2), ("A หรือ B หรือ C", "A หรือ B หรือ C", 1), ("((A))", "A", 0),
    ],
)
def test_prerequisites(raw, canonical, depth):
    ok, shown, _, d, at, _ = parsers.parse_prerequisite(raw)
    assert (ok, shown, d, at) == (True, canonical, depth, None)
    assert parsers.parse_prerequisite(shown)[1] == shown


@pytest.mark.parametrize(("raw", "at"), [("A and", 5), ("(A or B", 7), (")", 0), ("A B", 2), ("A)", 1), ("x" * 21, 0), ("x" * 501, 500), ("A และ และ B", 6)])
def test_wrong_prerequisites(raw, at):
    ok, _, codes, _, index, why = parsers.parse_prerequisite(raw)
    assert not ok and codes == [] and index == at and why


_trees = st.recursive(
    st.text("ABC012", min_size=1, max_size=4).map(lambda c: ("code", "k" + c)),
    lambda kids: st.tuples(st.sampled_from(["and", "or"]), st.lists(kids, min_size=2, max_size=3)),
    max_leaves=6,
)


@given(_trees)
@settings(max_examples=150, deadline=None)
def test_prerequisite_round_trip(tree):
    shown = parsers._show(tree)
    ok, again, _, _, _, why = parsers.parse_prerequisite(shown)
    assert (ok and parsers.parse_prerequisite(again)[1] == again) or why in ("too deep", "too many codes")


@pytest.mark.parametrize(("page", "n"), [("", 0), ("  \n", 0), ("x" * 30, 1), ("a" * 3000, 5), ("1. หัวข้อ\n" + "b " * 300 + "\n2. ต่อ\n" + "c " * 300, 2)])
def test_chunks(page, n):
    chunks = pages.chunk_page(page)
    assert len(chunks) == n and all(0 < len(t) <= pages.LARGE for _, t in chunks)


def test_tables():
    cells = list(pages.page_tables("intro\nรหัสวิชา\tชื่อวิชา\nCS101\tIntro\nCS102\n\nรหัส\tชื่อ\n"))
    assert [c[:4] for c in cells] == [(1, 1, 1, "รหัสวิชา"), (1, 1, 2, "ชื่อวิชา"), (1, 2, 1, "CS101"), (1, 2, 2, "Intro")]
    assert [c[3] for c in pages.page_tables("code|name|x\na|b")][-1] == ""


def test_score_and_route(spark):
    assert one(spark, pages.page_score(F.lit(1200), F.lit(0.0), F.lit(0.0), F.lit(12))) == pytest.approx(1.0)
    assert [one(spark, pages.page_route(F.lit(c), F.lit(i).cast("double"))) for c, i in ((0, 0.0), (5, 0.6), (5, 0.3), (5, 0.4), (5, None))] == ["deep", "deep", "fast", "standard", "fast"]


def test_lines_put_marks_on_their_letters(spark):
    rows = [(1, "ก", 0.0, 8.0, 100.0, 16.0, 0), (1, "่", 4.0, 4.0, 100.0, 16.0, 1), (1, "ี", 4.0, 4.0, 100.0, 16.0, 2), (1, "ข", 8.0, 16.0, 100.5, 16.0, 3), (1, "ค", 0.0, 8.0, 140.0, 16.0, 4)]
    got = [(r.line, r.text) for r in pages.assemble_lines(spark.createDataFrame(rows, pages.GLYPHS)).orderBy("line").collect()]
    assert got == [(0, "กี่ข"), (1, "ค")]


def test_quota_counts_in_order_over_parts(spark):
    rows = [(i, i % 3 == 0) for i in range(200)]
    got = {r.i: (r.used, r.granted) for r in relational.running_quota(spark.createDataFrame(rows, "i int, e boolean"), F.col("e"), ["i"], 20).collect()}
    used = 0
    for i, e in rows:
        used += e
        assert got[i] == (used, e and used <= 20)


def test_bm25_keeps_statistics_of_all_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "c"), (4, None), (5, "")], "id int, text string").filter("text IS NOT NULL")
    all_ = {r.id: r.score for r in retrieval.bm25(df, "id", "text", ["a"]).collect()}
    some = {r.id: r.score for r in retrieval.bm25(df, "id", "text", ["a"], F.col("id") == 2).collect()}
    assert set(all_) == {1, 2} and some == {2: all_[2]}


def test_maxsim(spark):
    v = lambda rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    assert one(spark, retrieval.maxsim(v([[1, 0, 0], [0, 1, 0]]), v([[1, 0, 0]]))) == pytest.approx(0.5)
    assert one(spark, retrieval.maxsim(v([[1, 0]]), v([[0, 1], [1, 0]]))) == pytest.approx(1.0)
    assert one(spark, retrieval.maxsim(v([[3, 0]]), v([[0, 5]]))) == pytest.approx(0.0)


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "id string, rank int")
    got = {r.id: r.fused for r in retrieval.reciprocal_rank_fusion(a, b, "id", both=1.3).collect()}
    assert got["x"] == pytest.approx(1.3 / 61) and got["y"] == got["z"] == pytest.approx(0.5 / 62)


def test_rerank_keeps_the_tail(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.9), ("c", 3, 5.0)], "id string, rank int, s double")
    assert [r.id for r in retrieval.rerank_prefix(df, "id", 2, "s").orderBy("new_rank").collect()] == ["b", "a", "c"]


def test_halting(spark):
    seq = {"gain": [0.5, 0.51], "osc": [0.5, 0.9, 0.6, 1.9], "nan": [float("nan")], "on": [0.5]}
    rows = [(k, i, v) for k, s in seq.items() for i, v in enumerate(s)]
    df = state.halt_replay(spark.createDataFrame(rows, "k string, i int, s double"), ["k"], ["i"], F.col("s"), F.lit(0.1))
    got = {r.k: (r.steps, r.reason) for r in df.collect()}
    assert got == {"gain": (2, "gain_below_cost"), "osc": (3, "gain_below_cost"), "nan": (1, "nan_guard"), "on": (1, None)}


def test_breaker_and_adjudication(spark):
    rows = [("k", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0])]
    df = state.circuit_breaker(spark.createDataFrame(rows, "k string, i int, f int"), ["k"], ["i"], F.col("f") == 1)
    assert [r.open for r in df.orderBy("i").collect()] == [False] * 6 + [True]
    votes = spark.createDataFrame([("r", 1, 0.895), ("r", 2, 0.9), ("q", 1, None), ("q", 2, 0.1)], "r string, stage int, c double")
    assert sorted((x.r, x.stage) for x in state.adjudicate(votes, ["r"], "stage", "c").collect()) == [("q", 2), ("r", 1)]


def test_rules(spark):
    rows = [("5", ">=", "5", True), ("x", ">=", "5", False), (None, "=", "5", False), ("b", "in", "a, b", True), ("b", "=", "b", True), ("4", "<", "4", False)]
    df = spark.createDataFrame(rows, "a string, c string, v string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", rule_holds(F.col("a"), F.col("c"), F.col("v"))).collect())


def test_answers(spark):
    rows = [
        (1, "Fact one is here [cite-001]. Unknown [cite-009].\n- both [cite-001] [cite-009]\n== head\nLong claim without any.", ["cite-001"], None),
        (2, "Total credits are 120. Another 7 credits.", [], {"credits": "135"}), (3, None, None, {}), (4, "", [], {"a$b": "1"}), (5, "cost a$b: 20 or 5.", [], {"a$b": "1\\0"}),
    ]
    df = spark.createDataFrame(rows, "k int, answer string, issued array<string>, values map<string,string>")
    got = {r.k: (r.validated, r.passed, r.removed, r.unsupported, r.replaced) for r in answers.validate_answers(df, "k", "values").collect()}
    assert got[1][1:4] == (2, 2, 1) and got[1][0] == "Fact one is here [cite-001].\n- both [cite-001]\n== head\nLong claim without any."
    assert got[2][0] == "Total credits are 135.\nAnother 135 credits." and got[2][4] == 2
    assert got[3][0] == got[4][0] == "" and got[5][0] == "cost a$b: 1\\0 or 5."


def test_repeated_courses_go_with_their_entries(spark):
    texts = ["a 06016101\n  - x\nb 06016101\n  - y\nc", "06016101 A\n- x\n06016101 A again\n- y\nend\n- z", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k: r.deduped for r in answers.dedupe_answers(df, "k", "t").collect()} == {0: "a 06016101\n  - x\nc", 1: "06016101 A\n- x\nend\n- z", 2: "", 3: ""}


def test_questions(spark):
    q = {"06016101 กี่หน่วยกิต": "L1", "ปี 2 ภาค 1 มีวิชาอะไรบ้าง": "L2", "06016101 วิชาก่อน": "L3", "เปรียบเทียบ 2560 2565": "L4", "สวัสดี": "L2"}
    for text_, level in q.items():
        assert one(spark, answers.classify(F.lit(text_))).level == level
    assert one(spark, answers.study_year(F.lit("ปีที่สอง"))) == 2 and one(spark, answers.program_of(F.lit("xBIT BIT?"), ["IT", "BIT"])) == "BIT"


def test_metrics(spark):
    assert one(spark, evaluation.character_error_rate(F.lit("กา"), F.lit("กาก"))) == pytest.approx(1 / 3)
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    r = evaluation.f1(a, b, ["k"]).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (1, 0.5, 0.5, 0.5)
    m = spark.createDataFrame([("a", 0.04, 30, "<=", 0.05), ("b", 0.9, 5, ">=", 0.9)], "name string, value double, n int, comparator string, target double")
    assert {x.name: (x.status, x.passed) for x in evaluation.metric_status(m).collect()} == {"a": ("measured", True), "b": ("estimate", None)}


def test_codes_beside_marks(spark):
    for s, n in (("รหัส06016481", 0), ("ที่06016481", 1), ("x 06016481 y", 1), ("๐๖๐๑๖๔๘๑", 1), ("106016481", 0)):
        assert one(spark, F.regexp_count(F.lit(s), F.lit(text.CODE))) == n


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"one")
    (tmp_path / "b.pdf").write_bytes(b"one")
    docs = {r.relative_path: r for r in files.corpus(spark, str(tmp_path)).collect()}
    assert set(docs) == {"a/x.pdf", "b.pdf"} and docs["b.pdf"].canonical_id == docs["a/x.pdf"].document_id
    (tmp_path / "c.json").write_text('{"program":"P","courses":[{"code":"1","year":"1"},{"code":"2","year":2},{"code":"หมายเหตุ x"}]}')
    assert [(r.code, r.year) for r in files.course_json(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == [("1", "1"), ("2", "2")]
    blob = bytearray(struct.pack("<3f", 1.5, -0.25, 0.0))
    got = files.vectors(spark.createDataFrame([(blob,), (bytearray(b"1"),)], "v binary"), "v", 3).collect()
    assert [list(r.vector) for r in got] == [[1.5, -0.25, 0.0]]


def test_difference_and_upsert(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",), ("z",)], "k string")
    assert sorted(map(tuple, relational.difference_both_ways(a, b, "k", "old", "new").collect())) == [("new", "z"), ("old", "x")]
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert {(r.k, r.v) for r in relational.first_per_group(rows, ["k"], [F.desc("v")]).collect()} == {(1, "b"), (None, "c")}


def test_courses_and_requirements(spark):
    from loomfold.operators import extraction

    text_ = "ปีที่ 2 ภาคการศึกษาที่ 1\n06016101 โครงสร้างข้อมูล\nDATA STRUCTURES\n3(3-0-6)\nวิชาบังคับก่อน : 06016100 3(3-0-6)\n06016102 ไม่มีหน่วยกิต\n06016104\n\n\n\n\n\nปีที่ 3 ภาคการศึกษาที่ 2\n06016103 ฐานข้อมูล DATABASE SYSTEMS 3 (2-2-5)"
    rows = extraction.course_rows(spark.createDataFrame([(1, text_), (2, None), (3, "no code")], "k long, t string"), "k", "t").orderBy("ord").collect()
    assert [(r[2], r[3], r[4], r[5:9], r[9:]) for r in rows] == [("06016101", "โครงสร้างข้อมูล", "DATA STRUCTURES 3", (3, 3, 0, 6), (2, 1)), ("06016103", "ฐานข้อมูล", "DATABASE SYSTEMS 3", (3, 2, 2, 5), (3, 2))]
    df = spark.createDataFrame([(1, text_), (2, None), (3, "วิชาบังคับก่อน 06016101"), (4, "06016105 วิชาบังคับก่อน ไม่มี")], "k long, t string")
    got = {(r.key, r.code): (r.codes, r.raw) for r in extraction.requirement_rows(df, "k", "t").collect()}
    assert got[(1, "06016101")][0] == ["06016100"] and got[(4, "06016105")] == ([], "ไม่มี") and not [k for k in got if k[0] in (2, 3)]


def test_boxes_and_replacement(spark):
    from loomfold.operators import extraction

    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    assert one(spark, extraction.intersection_over_union(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, extraction.intersection_over_union(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    df = spark.createDataFrame([("a" * 40, "b" * 61), ("a" * 41, "b" * 61), (None, "b" * 51), ("a", None)], "t string, s string")
    assert [r.x[0] for r in df.select(extraction.replace_by_scan(df, "t", "s").alias("x")).collect()] == ["b", "a", "b", "a"]


def test_keywords_and_topic(spark):
    assert one(spark, retrieval.keywords(F.lit("BIT วิชา database อะไร database a"), F.lit("BIT"))) == ["database"]
    assert one(spark, retrieval.topic(F.lit("มีวิชาอะไร database บ้าง?"))) == "database"


def test_thai_normal_form(spark):
    from loomfold.functions import thai

    cases = {"ป\uf702ที\uf70aหนึ่ง": "ปีที่หนึ่ง", "ก  ่า": "ก่า", "ก่ี": "กี่", "คงอยู่ และ": "คงอยู่ และ", "Cafe\u0301": "Café", "": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", thai.normal_text(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] is None


@given(st.text(st.sampled_from(list("กขัิ่้์ํ า")), max_size=12))
@settings(max_examples=150, deadline=None)
def test_order_of_marks_keeps_all_signs(s):
    from loomfold.functions import thai

    once = thai.ordered(s)
    assert sorted(once) == sorted(s) and thai.ordered(once) == once
