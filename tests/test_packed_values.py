from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomfold.operators.packed_values import explode_packed, packed_values

CASES = [
    ("07036477, 41207xxx, “41207832”", ["07036477", "41207xxx", "41207832"]),
    ('("Marketing | Simulation" or 07036565) and 07036133', ["Marketing | Simulation", "07036565", "07036133"]),
    ('07036273  "Server ""Equipment"" 1"', ["07036273", 'Server "Equipment" 1']),
    ("'07036125', '41207791'", ["07036125", "41207791"]),
    ("07036180(ควบ)+41207618 (min. C, no W)", ["07036180(ควบ)", "41207618 (min. C, no W)"]),
    ("41207862, , 41207787, 07036482 [D+]", ["41207862", "41207787", "07036482 [D+]"]),
    ("1) 07036199\r\n2) 07036351\r\n", ["07036199", "07036351"]),
    ("• 07036290\n• ภูมิสารสนเทศและเวชระเบียน", ["07036290", "ภูมิสารสนเทศและเวชระเบียน"]),
    ("เรียนมาแล้วไม่น้อยกว่า 60 หน่วยกิต หรือตามที่คณะกำหนด", ["เรียนมาแล้วไม่น้อยกว่า 60 หน่วยกิต หรือตามที่คณะกำหนด"]),
    ("0 หน่วยกิตหรือ3(3-0-6)", ["0 หน่วยกิต", "3(3-0-6)"]),
    ("4 creditsหรือ4(3-2-7)", ["4 credits", "4(3-2-7)"]),
    ("3(3 - 0 - 6) และ 3 (0-9-0) นก.", ["3(3 - 0 - 6)", "3 (0-9-0) นก."]),
    ("07036385หรือ07036233", ["07036385", "07036233"]),
    ("07036313 \nหรือ \n41207813", ["07036313", "41207813"]),
    ("Structured Paragraph | language and optimisation", ["Structured Paragraph", "language and optimisation"]),
    ("accounting, examination", ["accounting, examination"]),
    ("วิชา 07036085, ปี 2", ["วิชา 07036085, ปี 2"]),
    ("07036085;;07036085", ["07036085", "07036085"]),
    ("", []), ("  \n ", []), (" ; | , ", []), (None, []),
]


def test_values(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string").withColumn("v", packed_values(F.col("c")))
    got = {r.i: r.v for r in df.collect()}
    for i, (cell, want) in enumerate(CASES):
        assert (got[i] or []) == want, cell


def test_rows_of_cells_with_two_values_or_more(spark):
    df = spark.createDataFrame([(1, "07036001;07036002", "x", "a"), (2, "07036003", None, "b"), (2, "07036001;07036002", "", "c")], "row_id long, code string, field string, value string")
    got = sorted(map(tuple, explode_packed(df, "row_id", ["code", "field"]).collect()))
    assert got == [(1, "code", 1, "07036001"), (1, "code", 2, "07036002"), (2, "code", 1, "07036001"), (2, "code", 2, "07036002")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, code string")
    assert explode_packed(df, "row_id", ["code"]).count() == 0


@pytest.mark.parametrize("n", [1, 4000])
def test_long_cell(spark, n):
    df = spark.createDataFrame([(1, ", ".join(f"{i:08d}" for i in range(n)))], "row_id long, code string")
    assert explode_packed(df, "row_id", ["code"], least=1).count() == n
