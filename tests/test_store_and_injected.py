from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomfold import config
from loomfold.functions import injected
from loomfold.operators import evidence, questions
from loomfold.sources import files, store
from loomfold.streaming import events


def test_embedding_isolates_failures(spark):
    class Picky(injected.StubEmbedder):
        def encode(self, texts):
            if "bad" in texts:
                raise ValueError("cannot read bad")
            return [[0.5] if t == "short" else v for t, v in zip(texts, super().encode(texts), strict=True)]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, ""), (5, "short")], "k int, t string")
    good, rejected = injected.index_vectors(injected.embed(df, "k", "t", Picky(4)), "k")
    assert {r.k: len(r.vector) for r in good.collect()} == {1: 4, 4: 4}
    assert {r.k: r.problem for r in rejected.collect()} == {2: "cannot read bad", 3: "no text", 5: "1 numbers instead of 4"}


def test_replies_and_selected_codes(spark):
    def reply(p):
        if p == "fail":
            raise RuntimeError("busy")
        return f"take 06016101, 123 and 0601610211 for {p}"

    df = spark.createDataFrame([(1, "x"), (2, "fail"), (3, None)], "k int, p string")
    got = {r.k: r for r in injected.generate(df, "k", "p", injected.StubLanguageModel(reply)).withColumn("codes", questions.selected_codes(F.col("reply"), F.array(F.lit("06016101")))).collect()}
    assert got[1].codes == ["06016101"] and got[2].codes is None and (got[2].problem, got[3].problem) == ("busy", "no prompt")


def test_pages_with_bad_ones_in_quarantine(spark):
    def pages(data):
        if data == b"broken":
            raise OSError("cannot open")
        for i, part in enumerate(data.split(b"|"), 1):
            yield i, lambda part=part: {"text": part.decode(), "width_pt": 10.0, "height_pt": 10.0, "images": [(20, 20)] if part == b"img" else []}

    df = spark.createDataFrame([("a", bytearray(b"one|\xff|img")), ("b", bytearray(b"broken")), ("c", None)], "k string, content binary")
    good, bad = injected.quarantined(injected.pages_of(df, "k", "content", pages))
    assert {(r.k, r.page_number): (r.text, r.image_area_ratio) for r in good.collect()} == {("a", 1): ("one", 0.0), ("a", 3): ("img", 1.0), ("c", 1): ("", 0.0)}
    assert {(r.k, r.page_number) for r in bad.collect()} == {("a", 2), ("b", 0)}
    assert injected.pages_of(df, "k", "content", pages, most=1).filter("k = 'a'").count() == 1


def test_store_appends_and_publishes(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert set(s.missing()) == set(store.SCHEMAS)
    s.create()
    s.create()
    assert s.missing() == [] and s.read("document").count() == 0
    rows = spark.createDataFrame([("f1", "t1", "copy", "n"), ("f1", "t1", "copy", "again"), (None, "t2", "copy", "n")], "from_id string, to_id string, relation string, note string")
    assert s.append("document_relation", rows).count() == 1
    s.append("document_relation", rows)
    assert s.read("document_relation").count() == 1
    versions = spark.createDataFrame([(1, "BIT", 2566, "current"), (2, " ", 2566, "current"), (3, "NIS", None, "old")], "version_id bigint, program string, curriculum_year int, edition_status string")
    assert s.publish({"curriculum_version": versions}, {"curriculum_version": store.stamped(versions)}) == ["curriculum_version"]
    assert s.read("curriculum_version").count() == 0
    good = versions.filter("version_id = 1")
    assert s.publish({"curriculum_version": good}, {"curriculum_version": store.stamped(good)}) == [] and s.read("curriculum_version").count() == 1
    s.append("curriculum_version", versions, store.stamped(versions))
    assert s.issues("invalid_curriculum_version").count() == 2 and s.issues().count() == 4


def test_boxes_hashes_and_json(spark):
    pages = spark.createDataFrame([("d", 1, 100.0, 200.0)], "document_id string, page int, width_pt double, height_pt double")
    boxes = [("d", 1, 0.0, 0.0, 100.4, 10.0), ("d", 1, 0.0, 0.0, 100.6, 10.0), ("d", 1, 9.0, 0.0, 5.0, 10.0), ("d", 2, 0.0, 0.0, 1.0, 1.0), ("d", 1, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert store.outside_page(df, pages, ["document_id", "page"]).count() == 4
    assert tuple(store.merged_box(df, ["document_id", "page"]).filter("page = 1").first())[2:] == (0.0, 0.0, 100.6, 10.0)
    one = df.limit(1)
    assert [c.x0 for c in one.select(store.column_boxes(F.struct("x0", "y0", "x1", "y1"), 4).alias("c")).first().c] == pytest.approx([0, 25.1, 50.2, 75.3])
    assert one.select(store.font_size(F.lit(0.0), F.lit(None).cast("double")), store.font_size(F.lit(3.0), F.lit(9.0))).first()[:] == (1.0, 9.0)
    assert one.select(store.is_hash(F.lit("a" * 64)), store.is_hash(F.lit("A" * 64)), store.is_hash(F.lit(None).cast("string"))).first()[:] == (True, False, False)
    assert spark.createDataFrame([("ก", None, 1)], "b string, a string, c int").select(store.canonical_json(spark.createDataFrame([], "b string"), ["c", "b", "a"]).alias("j")).first().j == '{"a":null,"b":"ก","c":1}'


def test_gold_set(spark, tmp_path):
    whole = {"gold_id": 1, "kind": "page_text", "document_id": "d", "page_number": 3, "curriculum_version": {"program": "BIT", "curriculum_year": 2566, "edition_status": "current"}, "expected": {"text": "x"}}
    (tmp_path / "a.json").write_text(json.dumps([whole, {"gold_id": 2, "item_kind": "question"}]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"gold_id": 3, "item_kind": "table_cell", "document_id": "d", "page": 1, "version": {"program": "BIT"}}, {"gold_id": 4}]}))
    got = {r.gold_id: r for r in files.gold_set(spark, str(tmp_path)).collect()}
    assert got[1].problem is None and got[1].page == 3 and got[1].version.program == "BIT" and got[1].expected == {"text": "x"}
    assert got[2].problem == "question_level" and got[4].problem == "item_kind" and got[3].problem is None and got[3].version is None and got[3].warning


def test_settings(tmp_path):
    at = tmp_path / "s.toml"
    at.write_text("[retrieval]\nlexical_top_k = 20\n[server]\nhost = 'localhost'\n")
    assert config.load(at).lexical_top_k == 20 and config.problems(config.Settings()) == []
    for text, why in {"weight_chars = 0.5": "sum to 1", "nope = 1": "unknown", "host = 3": "wrong type", "response_cap = 501": "between", "rerank_depth = 60": "rerank_depth", "lexical_top_k = 1.5": "wrong type"}.items():
        at.write_text(text)
        with pytest.raises(ValueError, match=why):
            config.load(at)
    assert config.problems(config.Settings(), {"a": "b"}, frozenset("c")) == ["synonym a has no accepted value"]


def test_evidence_graph(spark):
    nodes = [("r", "a", 0, 1, "d", "x"), ("r", "b", 0, 2, None, "x"), ("r", "c", 0, 3, "d", "y"), ("r", "a", 1, 4, "d", "x"), ("r", "e", 1, 5, "d", "x"), ("r", "f", 1, 6, "d", "x"), ("r", "g", 2, 7, "d", "x"), ("q", "a", 0, 8, "d", None)]
    df = spark.createDataFrame(nodes, "req string, node string, hop int, n int, doc string, v string")
    got = {(r.req, r.node, r.hop): r.verdict for r in evidence.admit_nodes(df, "req", "node", "hop", ["n"], ["doc"], F.col("v") == "x", most=2, per_hop=1).collect()}
    assert got == {("r", "a", 0): "taken", ("r", "b", 0): "missing_provenance", ("r", "c", 0): "other_version", ("r", "a", 1): "duplicate", ("r", "e", 1): "taken", ("r", "f", 1): "hop_full", ("r", "g", 2): "full", ("q", "a", 0): "other_version"}
    edges = spark.createDataFrame([("r", "a", "b", 1), ("r", "b", "c", 2), ("r", "c", "a", 3), ("r", "a", "a", 4), ("r", "a", "c", 5), ("q", "c", "a", 1)], "req string, s string, t string, n int")
    assert {(r.req, r.n): r.taken for r in evidence.acyclic_edges(edges, "req", "s", "t", "n").collect()} == {("r", 1): True, ("r", 2): True, ("r", 3): False, ("r", 4): False, ("r", 5): True, ("q", 1): True}


def test_routes_and_topics(spark):
    rows = [("วิชา 06016101 กี่หน่วยกิต", 1), ("วิชา 06016101 กี่หน่วยกิต", 0), ("hello", None), ("", None), ("x" * 501, None), (None, None)]
    got = [r.r for r in spark.createDataFrame(rows, "q string, n int").select(questions.route(F.col("q"), F.col("n"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("r")).collect()]
    assert (got[0].level, got[0].path, got[0].versions) == ("L1", "structured", []) and (got[1].level, got[1].path, got[1].escalated, got[1].versions) == ("L3", "evidence_planner", True, ["a", "b"])
    assert got[2].rule.startswith("router_fallback(") and got[2].level == "L3" and [g.valid for g in got] == [True, True, True, False, False, False] and got[5].level is None
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(questions.topic_keywords(F.lit("หลักสูตร BIT: coding ฐานข้อมูล"), F.lit("BIT"))) == ["โปรแกรม", "programming", "ฐานข้อมูล", "database"]
    assert one(questions.no_evidence(F.array(F.lit("BIT 2566")))).endswith("BIT 2566")
    assert one(questions.stem_match(F.lit("warehousing"), F.lit("Warehouse"))) and not one(questions.stem_match(F.lit("data"), F.lit("date"))) and one(questions.stem_match(F.lit("it"), F.lit("bit")))
    assert one(questions.escaped_terms(F.lit('a-b "c" (d)*'))) == ['"a"', '"b"', '"c"', '"d"']
    plan = "ปีที่ 1 ภาคการศึกษาที่ 1\nวิชาเลือกกลุ่มวิทยาการ 3 หน่วยกิต\nวิชาเลือกกลุ่มวิทยาการ 3\nปีที่ 1 ภาคการศึกษาที่ 2\nวิชาเลือกกลุ่มอื่นที่ไกล 2"
    assert one(questions.elective_slots(F.lit(plan), 1, 1)) == ["วิชาเลือกกลุ่มวิทยาการ"] and one(questions.elective_slots(F.lit("none"), 1, 1)) == []
    assert one(questions.foreign_institution(F.lit("สถาบันฯ และ มหาวิทยาลัยอื่น"), "สถาบันตัวอย่าง")) == "มหาวิทยาลัยอื่น" and one(questions.foreign_institution(F.lit("สถาบันตัวอย่าง"), "สถาบันตัวอย่าง")) is None
    assert one(questions.in_synonyms(F.lit("a"), {"a": "b"})) == "b" and one(questions.in_synonyms(F.lit("c"), {"a": "b"})) == "c"


def test_batches_merge_into_one_state(spark, tmp_path):
    src, out, at = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp"
    schema = "k int, ts int, v string"
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], [(1, 3, "d"), (3, 1, "e")], [(2, 0, "old"), (3, 1, "tie")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        kinds = spark.read.parquet(src).schema
        events.upsert_batches(events.file_stream(spark, src, "*.parquet", kinds, files=1), ["k"], "ts", out, at).awaitTermination()
    want = {1: "d", 2: "b", 3: "tie"}
    assert {r.k: r.v for r in events.current(spark, out, ["k"], "ts", kinds).collect()} == want
    # the last batch again, as after a failure: its folder is written over
    last = spark.createDataFrame([(2, 0, "old"), (3, 1, "tie")], schema)
    last.write.mode("overwrite").parquet(f"{out}/_batch=2")
    assert {r.k: r.v for r in events.current(spark, out, ["k"], "ts", kinds).collect()} == want
