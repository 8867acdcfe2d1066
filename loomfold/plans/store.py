"""Queries on boxes, keys, typed cells, reports, and functions that users bring along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.functions import injected
from loomfold.operators import evaluation, graph, hierarchy, questions
from loomfold.plans import evaluate
from loomfold.plans.registry import Registry
from loomfold.sources import store
from loomfold.sources.tables import table

R = Registry()
_BOX = "(region_id % 70) * 10.0 AS x0, (stage_result_id % 90) * 10.0 AS y0, (region_id % 70) * 10.0 + 60.0 AS x1, (stage_result_id % 90) * 10.0 + 30.0 AS y1"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each reading, made of its keys: some stick out of the page."""
    return table(spark, d, "stage_result").selectExpr("stage_result_id", "region_id", "page_id", *_BOX.split(", "))


@R.add("boxes_outside", f"SELECT stage_result_id FROM (SELECT *, {_BOX} FROM stage_result) b LEFT JOIN page p ON p.page_id = b.page_id WHERE NOT COALESCE(x0 >= -0.5 AND y0 >= -0.5 AND x1 <= width_pt + 0.5 AND y1 <= height_pt + 0.5 AND x0 <= x1 AND y0 <= y1, false)")
def boxes_outside(spark: SparkSession, d: str) -> DataFrame:
    return store.outside_page(_boxes(spark, d), table(spark, d, "page"), ["page_id"]).select("stage_result_id")


@R.add("merged_boxes", f"SELECT page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT page_id, {_BOX} FROM stage_result) GROUP BY page_id")
def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    return store.merged_box(_boxes(spark, d), ["page_id"])


@R.add("column_positions", f"SELECT stage_result_id, i AS col, round(x0 + (x1 - x0) / 4 * i, 6) AS x0, round(x0 + (x1 - x0) / 4 * (i + 1), 6) AS x1 FROM (SELECT stage_result_id, {_BOX} FROM stage_result), (SELECT CAST(range AS INTEGER) AS i FROM range(4))")
def column_positions(spark: SparkSession, d: str) -> DataFrame:
    cut = _boxes(spark, d).select("stage_result_id", F.posexplode(store.column_boxes(F.struct("x0", "y0", "x1", "y1"), 4)).alias("col", "b"))
    return cut.select("stage_result_id", "col", F.round("b.x0", 6).alias("x0"), F.round("b.x1", 6).alias("x1"))


@R.add("glyph_sizes", "SELECT page_id, CASE WHEN greatest(COALESCE(width_pt, 0), COALESCE(height_pt, 0)) > 0 THEN greatest(COALESCE(width_pt, 0), COALESCE(height_pt, 0)) ELSE 1.0 END AS size FROM page")
def glyph_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page").select("page_id", store.font_size(F.col("width_pt"), F.col("height_pt")).alias("size"))


@R.add("canonical_json", "SELECT document_id, CAST(to_json({'curriculum_year': curriculum_year, 'edition_status': edition_status, 'program': program}) AS VARCHAR) AS j FROM document")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document")
    return rows.select("document_id", store.canonical_json(rows, ["program", "curriculum_year", "edition_status"]).alias("j"))


@R.add("hash_shapes", "SELECT document_id, COALESCE(regexp_full_match(sha256, '[0-9a-f]{64}'), false) AS ok FROM document")
def hash_shapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document").select("document_id", store.is_hash(F.col("sha256")).alias("ok"))


@R.add("stamped_versions", "SELECT document_id, COALESCE(trim(program) <> '', false) AND curriculum_year IS NOT NULL AND COALESCE(trim(edition_status) <> '', false) AS ok FROM document")
def stamped_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document")
    return rows.select("document_id", store.stamped(rows).alias("ok"))


@R.add("alternative_codes", "SELECT row_id, array_to_string(list_filter(list_transform(string_split(replace(nfc_normalize(code), chr(10), ' '), 'หรือ'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS codes FROM bit_academic_plan_coop WHERE contains(code, 'หรือ')")
def alternative_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bit_academic_plan_coop").filter(F.col("code").contains("หรือ"))
    parts = F.filter(F.transform(F.split(F.replace("code", F.lit("\n"), F.lit(" ")), "หรือ"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("row_id", F.array_join(parts, "|").alias("codes"))


_FIRST = "trim(split_part(credits, 'หรือ', 1), ' ')"


@R.add("first_credits", f"SELECT row_id, CASE WHEN regexp_full_match({_FIRST}, '\\d{{1,2}}\\(\\d{{1,2}}-\\d{{1,2}}-\\d{{1,2}}\\)') THEN CAST(regexp_extract({_FIRST}, '^(\\d+)', 1) AS INTEGER) END AS total FROM bit_academic_plan_coop WHERE credits IS NOT NULL")
def first_credits(spark: SparkSession, d: str) -> DataFrame:
    first = F.trim(F.split("credits", "หรือ")[0])
    total = F.when(first.rlike(r"\A\d{1,2}\(\d{1,2}-\d{1,2}-\d{1,2}\)\z"), F.regexp_extract(first, r"^(\d+)", 1).cast("int"))
    return table(spark, d, "bit_academic_plan_coop").filter("credits IS NOT NULL").select("row_id", total.alias("total"))


@R.add(
    "sign_surplus",
    """WITH s AS (SELECT region_id, stage_index, unnest(regexp_extract_all(text, '[a-z]')) AS c FROM stage_result WHERE text IS NOT NULL), a AS (SELECT region_id, c, count(*) AS n FROM s WHERE stage_index = 1 GROUP BY 1, 2), b AS (SELECT region_id, c, count(*) AS n FROM s WHERE stage_index = 2 GROUP BY 1, 2)
    SELECT a.region_id, a.c AS sign, a.n - COALESCE(b.n, 0) AS surplus FROM a LEFT JOIN b ON b.region_id = a.region_id AND b.c = a.c WHERE a.n > COALESCE(b.n, 0)""",
)
def sign_surplus(spark: SparkSession, d: str) -> DataFrame:
    """Letters that the first reading of a region has more often than the second."""
    signs = table(spark, d, "stage_result").select("region_id", "stage_index", F.explode(F.regexp_extract_all("text", F.lit("([a-z])"), F.lit(1))).alias("sign"))
    n = signs.groupBy("region_id", "sign").agg(F.count_if(F.col("stage_index") == 1).alias("a"), F.count_if(F.col("stage_index") == 2).alias("b"))
    return n.filter("a > b").select("region_id", "sign", (F.col("a") - F.col("b")).alias("surplus"))


@R.add("category_synonyms", "SELECT row_id, CASE category WHEN 'เฉพาะ' THEN 'หมวดวิชาเฉพาะ' WHEN 'แกน' THEN 'กลุ่มวิชาแกน' ELSE category END AS category FROM bit_academic_plan_coop WHERE category IS NOT NULL")
def category_synonyms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bit_academic_plan_coop").filter("category IS NOT NULL")
    return rows.select("row_id", questions.in_synonyms(F.col("category"), {"เฉพาะ": "หมวดวิชาเฉพาะ", "แกน": "กลุ่มวิชาแกน"}).alias("category"))


@R.add("prerequisite_set", "SELECT c.course_id, COALESCE(n.codes, c.prerequisite_json) AS prerequisite FROM course c LEFT JOIN (SELECT program, code, max(to_json(prerequisite_codes)) AS codes FROM normalized_course WHERE len(prerequisite_codes) > 0 AND NOT list_contains(list_transform(prerequisite_codes, lambda x: x IS NULL), true) GROUP BY 1, 2) n ON n.program = c.program AND n.code = c.code")
def prerequisite_set(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "normalized_course").filter("size(prerequisite_codes) > 0 AND NOT exists(prerequisite_codes, x -> x IS NULL)").groupBy("program", "code").agg(F.max(F.to_json("prerequisite_codes")).alias("codes"))
    return table(spark, d, "course").join(new, ["program", "code"], "left").select("course_id", F.coalesce("codes", "prerequisite_json").alias("prerequisite"))


@R.add(
    "picked_codes",
    """SELECT version_id, array_to_string(list_sort(list(DISTINCT code)), '|') AS codes FROM course WHERE version_id IS NOT NULL AND code IN (SELECT code FROM normalized_course) AND contains(code, '4') GROUP BY version_id""",
)
def picked_codes(spark: SparkSession, d: str) -> DataFrame:
    """What a reply of a stub names, limited to the codes of the version that the plans know."""
    known = table(spark, d, "normalized_course").select("code").distinct()
    valid = table(spark, d, "course").filter("version_id IS NOT NULL").select("version_id", "code").join(known, "code", "left_semi")
    per = valid.groupBy("version_id").agg(F.sort_array(F.collect_set("code")).alias("valid"))
    asked = per.withColumn("prompt", F.concat(F.array_join("valid", " "), F.lit(" 99999999")))
    model = injected.StubLanguageModel(lambda p: ", ".join(c for c in p.split() if "4" in c or c == "99999999"))
    replies = injected.generate(asked, "version_id", "prompt", model, 1_000_000)
    return asked.join(replies, "version_id").select("version_id", F.array_join(questions.selected_codes(F.col("reply"), F.col("valid")), "|").alias("codes")).filter("codes <> ''")


@R.add("vector_index", "SELECT (SELECT count(*) FROM chunk WHERE content_text IS NOT NULL) AS indexed, (SELECT count(*) FROM chunk WHERE content_text IS NULL) AS rejected, 8 AS dim")
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The chunks embedded by a stub: how many have a vector of its length, how many were rejected."""
    v = injected.embed(table(spark, d, "chunk"), "chunk_id", "content_text", injected.StubEmbedder(8))
    return v.agg(F.count("vector").alias("indexed"), F.count("problem").alias("rejected"), F.max(F.size("vector")).alias("dim"))


@R.add("recall_mean", f"SELECT count(*) AS queries, round(avg(recall), 6) AS recall FROM ({evaluate.R.sql['recall_at_k']})")
def recall_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_at_k(spark, d).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"))


@R.add("citation_mean", f'SELECT count(*) AS queries, round(avg("precision"), 5) AS "precision", round(avg(recall), 5) AS recall FROM ({evaluate.R.sql["citation_metrics"]})')
def citation_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.citation_metrics(spark, d).agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 5).alias("precision"), F.round(F.avg("recall"), 5).alias("recall"))


@R.add("field_f1_mean", f"SELECT round(avg(f1), 6) AS macro_f1, sum(n) AS n FROM ({evaluate.R.sql['field_macro_f1']})")
def field_f1_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.field_macro_f1(spark, d).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.sum("n").alias("n"))


@R.add("cer_mean")
def cer_mean(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cer_eval(spark, d).agg(F.count("*").alias("regions"), F.round(F.avg("cer"), 6).alias("cer"))


@R.add(
    "metric_report",
    f"""WITH m AS (SELECT 'recall_at_10' AS name, avg(recall) AS value, count(*) AS n, '>=' AS comparator, 0.9 AS target FROM ({evaluate.R.sql['recall_at_k']}) UNION ALL SELECT 'citation_precision', avg("precision"), count(*), '>=', 0.95 FROM ({evaluate.R.sql['citation_metrics']})
    UNION ALL SELECT 'field_f1', avg(f1), sum(n), '>=', 0.91 FROM ({evaluate.R.sql['field_macro_f1']}) UNION ALL SELECT 'low_quality_share', avg(CASE WHEN quality_score < 0.5 THEN 1.0 ELSE 0.0 END), count(*), '<', 0.05 FROM stage_result WHERE quality_score IS NOT NULL)
    SELECT name, round(value, 4) AS value, CAST(n AS BIGINT) AS n, CASE WHEN n >= 30 THEN 'measured' ELSE 'estimate' END AS status, CASE WHEN n >= 30 THEN CASE comparator WHEN '<' THEN round(value, 4) < target ELSE round(value, 4) >= target END END AS passed FROM m""",
)
def metric_report(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of a run in one table, each with its target and status."""

    def row(df: DataFrame, name: str, value, n, comparator: str, target: float) -> DataFrame:
        return df.agg(value.alias("value"), n.cast("long").alias("n")).select(F.lit(name).alias("name"), "value", "n", F.lit(comparator).alias("comparator"), F.lit(target).alias("target"))

    low = table(spark, d, "stage_result").filter("quality_score IS NOT NULL")
    rows = (
        row(evaluate.recall_at_k(spark, d), "recall_at_10", F.avg("recall"), F.count("*"), ">=", 0.9)
        .unionByName(row(evaluate.citation_metrics(spark, d), "citation_precision", F.avg("precision"), F.count("*"), ">=", 0.95))
        .unionByName(row(evaluate.field_macro_f1(spark, d), "field_f1", F.avg("f1"), F.sum("n"), ">=", 0.91))
        .unionByName(row(low, "low_quality_share", F.avg(F.when(F.col("quality_score") < 0.5, 1.0).otherwise(0.0)), F.count("*"), "<", 0.05))
    )
    return evaluation.metric_status(rows).select("name", F.round("value", 4).alias("value"), "n", "status", "passed")


@R.add("cycle_paths")
def cycle_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest circle through the first node of each group of courses that require each other."""
    edges = hierarchy.links(table(spark, d, "normalized_course"), "source_path", "code", "prerequisite_codes")[0]
    return graph.cycle_paths(edges, hierarchy.ancestors(edges)).select("grp", "node", F.array_join("path", ">").alias("path"))
