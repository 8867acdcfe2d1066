"""Queries over whole texts and tables: small fixtures against brute force."""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter

import pytest

from loomfold.plans import core

Q = core.queries()


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_code_extraction_keeps_thai_texts(spark, tmp_path):
    texts = ["12345678 and 12345678", "วิชา 06016401 และ 06016402, 06016401", "รหัส06016403", "ค่ 06016404", "ก่06016405 x06016406", "๐๖๐๑๖๔๐๗ 123456789", None, ""]
    d = save(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    want = {(i, c, n) for i, t in enumerate(texts) for c, n in Counter(re.findall(r"(?<!\w)\d{8}(?!\w)", t or "")).items()}
    assert {tuple(r) for r in Q["code_extraction"](spark, d).select("doc_id", "code", "n").collect()} == want and len(want) == 6


def test_question_year_keeps_number_words(spark, tmp_path):
    d = save(spark, tmp_path, "documents", [(1, "ปีที่สอง"), (2, "ปีสาม"), (3, "ปี 4 ไม่ใช่ปีหนึ่ง"), (4, "ไม่มี"), (5, None)], "doc_id long, text string")
    assert {tuple(r) for r in Q["question_year"](spark, d).select("doc_id", "year").collect()} == {(1, 2), (2, 3), (3, 4), (4, None)}


def test_answers_hold_whole_chunks(spark, tmp_path):
    late = "x" * 200 + " ends here. This is a late claim without a source. Another is cited [cite-002]. A third one is not"
    d = save(spark, tmp_path, "chunk", [(1, "d", 1, late), (2, "d", 1, None)], "chunk_id long, document_id string, page_start int, content_text string")
    r = Q["citations_validate"](spark, d).first()
    assert r.request_id == "d/1" and (r.passed, r.removed, r.unsupported) == (3, 0, 2) and "late claim" in r.validated and "A third one is not [cite-002]." in r.validated
    assert tuple(Q["unsupported_rate"](spark, d).select("unsupported", "claims").first()) == (2, 5)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_cer_counts_thai_characters(spark, tmp_path):
    pairs = [("กาแฟ", "กาแก"), ("วิชา 1\n2", "วิชา 12"), ("cafe\u0301", "caf\u00e9"), ("x😀", "xy"), ("กข", ""), ("abc", "abd"), ("ที่", "ที")]
    d = save(spark, tmp_path, "stage_result", [(i, s + 1, t) for i, p in enumerate(pairs) for s, t in enumerate(p)] + [(99, 1, "x"), (98, 2, None)], "region_id long, stage_index int, text string")
    nfc = [[unicodedata.normalize("NFC", t) for t in p] for p in pairs]
    want = {i: round(distance(a, b) / len(b), 6) if b else 0.0 for i, (a, b) in enumerate(nfc)}
    assert {r.region_id: r.cer for r in Q["cer_eval"](spark, d).collect()} == want and want[0] == 0.25 and want[2] == 0


def test_page_quality_takes_images_and_punctuation(spark, tmp_path):
    declared = {chr(x) for x in range(0xE00, 0xE80)} | set(string.ascii_letters + string.digits + ".,;:!?()[]{}<>/\\-–—_'\"“”‘’%&*+=@#$^~|`")
    texts = ["".join(sorted(declared)), "วิชา [1] – a^b~$c`d\\e", "•·é中 x", "", None, "ab", "ab"]
    images = {0: [0.25], 1: [0.1, 0.7], 3: [1.0], 5: [None]}
    d = save(spark, tmp_path, "page", list(enumerate(texts)), "page_id long, page_text string")
    save(spark, tmp_path, "page_metrics", [(p, x) for p, many in images.items() for x in many], "page_id long, image_area_ratio double")
    save(spark, tmp_path, "lexicon_term", [(1, "วิชา")], "term_id long, term string")
    want = {}
    for p, t in enumerate(texts):
        if t is not None:
            solid = [c for c in t if not c.isspace()]
            foreign = sum(c not in declared for c in solid) / len(solid) if solid else 0.0
            image = max((x for x in images.get(p, []) if x is not None), default=0.0)
            want[p] = round(0.45 * min(len(t) / 1200, 1) + 0.2 * (1 - foreign) + 0.2 * (1 - image) + 0.15 * min(t.count("วิชา") / 12, 1), 6)
    got = {r.page_id: r.score for r in Q["page_quality_score"](spark, d).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_assembled_lines_hold_whole_names(spark, tmp_path):
    names = ["ก" * 39 + "ขคงจ" * 10, "abc def " * 12 + "z", "กีกา", " ", None]
    d = save(spark, tmp_path, "course", [(i, 1, n) for i, n in enumerate(names * 9)], "course_id long, version_id long, name_th string")
    got = [(r.page_id, r.text) for r in Q["assembled_lines"](spark, d).orderBy("page_id", "line").collect()]
    assert got == [(i // 20, n) for i, n in enumerate(names * 9) if n and n.strip()]
