"""Queries on extraction of courses and requirements, record checks, copies and scored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import extraction, retrieval
from loomfold.operators.relational import cap_per_group
from loomfold.plans.registry import Registry
from loomfold.sources.tables import table

R = Registry()


@R.add("course_rows")
def course_rows(spark: SparkSession, d: str) -> DataFrame:
    return extraction.course_rows(table(spark, d, "chunk"), "chunk_id", "content_text")


@R.add("courses_populated")
def courses_populated(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk")
    version = chunks.select(F.col("chunk_id").alias("key"), F.concat_ws(":", "program", F.col("curriculum_year").cast("string"), "edition_status").alias("version"))
    return extraction.first_course(extraction.course_rows(chunks, "chunk_id", "content_text").join(version, "key"), "version")


@R.add("requirement_rows")
def requirement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Requirements named in page texts: the codes around the Thai word for credits stand in for the marker, which these pages lack."""
    return extraction.requirement_rows(table(spark, d, "page").filter("page_text IS NOT NULL"), "page_id", "page_text", "รหัสวิชา")


_SETS = {n: ", ".join(f"'{v}'" for v in many) for n, many in (("c", extraction.CATEGORIES), ("t", extraction.TYPES))}


@R.add(
    "field_records",
    f"""WITH v AS (SELECT row_id, CASE WHEN regexp_full_match(trim(year, ' '), '\\d{{1,4}}') AND CAST(trim(year, ' ') AS INTEGER) BETWEEN 1 AND 8 THEN CAST(trim(year, ' ') AS INTEGER) END AS y, COALESCE(trim(year, ' '), '') AS yr,
    CASE WHEN regexp_full_match(trim(semester, ' '), '\\d{{1,4}}') AND CAST(trim(semester, ' ') AS INTEGER) BETWEEN 1 AND 3 THEN CAST(trim(semester, ' ') AS INTEGER) END AS s, COALESCE(trim(semester, ' '), '') AS sr,
    CASE WHEN trim(category, ' ') IN ({_SETS['c']}) THEN trim(category, ' ') END AS c, COALESCE(trim(category, ' '), '') AS cr, CASE WHEN trim(type, ' ') IN ({_SETS['t']}) THEN trim(type, ' ') END AS t, COALESCE(trim(type, ' '), '') AS tr FROM bit_academic_plan_coop)
    SELECT row_id, y AS year_value, s AS semester_value, c AS category_value, t AS type_value, (y IS NULL AND yr <> '') AS bad_year, (s IS NULL AND sr <> '') AS bad_semester, (c IS NULL AND cr <> '') AS bad_category, (t IS NULL AND tr <> '') AS bad_type FROM v""",
)
def field_records(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.field_record(table(spark, d, "bit_academic_plan_coop"))
    return rows.select("row_id", "year_value", "semester_value", "category_value", "type_value", *[F.array_contains("issues", n).alias(f"bad_{n}") for n in ("year", "semester", "category", "type")])


@R.add(
    "replicated_pages",
    "SELECT c.document_id, p.page_number, length(p.page_text) AS n_chars, c.canonical_document_id AS canonical_id FROM document c JOIN page p ON p.document_id = c.canonical_document_id WHERE c.document_id <> c.canonical_document_id",
)
def replicated_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page").select("document_id", "page_number", F.length("page_text").alias("n_chars"))
    return extraction.replicate(table(spark, d, "document"), pages, "document_id", "canonical_document_id")


@R.add(
    "scan_replacements",
    """WITH s AS (SELECT page_id, max(text) AS t FROM stage_result WHERE is_selected GROUP BY page_id) SELECT p.page_id, CASE WHEN length(COALESCE(s.t, '')) > 1.5 * length(COALESCE(p.page_text, '')) AND length(COALESCE(s.t, '')) > 50 THEN length(s.t) ELSE length(p.page_text) END AS n, (length(COALESCE(s.t, '')) > 1.5 * length(COALESCE(p.page_text, '')) AND length(COALESCE(s.t, '')) > 50) AS replaced FROM page p JOIN s ON s.page_id = p.page_id""",
)
def scan_replacements(spark: SparkSession, d: str) -> DataFrame:
    scans = table(spark, d, "stage_result").filter("is_selected").groupBy("page_id").agg(F.max("text").alias("t"))
    rows = table(spark, d, "page").select("page_id", "page_text").join(scans, "page_id")
    new = extraction.replace_by_scan(rows, "page_text", "t")
    return rows.select("page_id", F.length(new).alias("n"), F.coalesce((F.length(F.coalesce("t", F.lit(""))) > 1.5 * F.length(F.coalesce("page_text", F.lit("")))) & (F.length(F.coalesce("t", F.lit(""))) > 50), F.lit(False)).alias("replaced"))


@R.add(
    "plan_aware_scores",
    """WITH x AS (SELECT chunk_id, COALESCE(content_text, '') AS raw, lower(regexp_replace(COALESCE(content_text, ''), '[\\x{0E48}-\\x{0E4C}]', '', 'g')) AS t, lower(regexp_replace(COALESCE(heading, ''), '[\\x{0E48}-\\x{0E4C}]', '', 'g')) AS h FROM chunk),
    s AS (SELECT chunk_id, CASE WHEN contains(t, 'หนวยกิต') THEN 1.0 ELSE 0 END + CASE WHEN contains(h, 'หนวยกิต') THEN 1.5 ELSE 0 END + CASE WHEN contains(t, 'database') THEN 1.0 ELSE 0 END + CASE WHEN contains(h, 'database') THEN 1.5 ELSE 0 END
    + CASE WHEN contains(t, 'แผนการศึกษา') OR contains(t, 'แผนการเรียน') OR contains(t, 'ชันปีที') OR contains(t, 'ปีที') OR contains(t, 'รายวิชา') OR contains(h, 'แผนการศึกษา') OR contains(h, 'แผนการเรียน') OR contains(h, 'ชันปีที') OR contains(h, 'ปีที') OR contains(h, 'รายวิชา') THEN 0.8 ELSE 0 END AS score FROM x)
    SELECT chunk_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0""",
)
def plan_aware_scores(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(F.lit("หน่วยกิต"), F.lit("database"))
    score = retrieval.plan_aware_score(F.col("content_text"), F.col("heading"), terms, None, True, False)
    return table(spark, d, "chunk").select("chunk_id", score.alias("score")).filter("score > 0")


@R.add("heading_keywords", None)
def heading_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("heading IS NOT NULL").select("chunk_id", retrieval.keywords(F.col("heading"), F.col("program")).alias("keywords"), retrieval.topic(F.col("heading")).alias("topic"))


@R.add(
    "two_tier_selection",
    """WITH s AS (SELECT stage_result_id, confidence AS score, contains(text, 'หน่วยกิต') AS lit FROM stage_result WHERE text IS NOT NULL AND confidence IS NOT NULL), b AS (SELECT max(score) AS best FROM s WHERE NOT lit)
    SELECT stage_result_id, CASE WHEN lit THEN 1 ELSE 2 END AS tier FROM s, b WHERE lit OR score >= greatest(0.6, best - 0.05)""",
)
def two_tier_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_result").filter("text IS NOT NULL AND confidence IS NOT NULL").select("stage_result_id", F.col("confidence").alias("score"), "text")
    return retrieval.two_tier(rows, F.col("text").contains("หน่วยกิต"), "score").select("stage_result_id", "tier")


@R.add(
    "prompt_units",
    """SELECT document_id, label, CAST(count(*) AS BIGINT) AS units, sha256(string_agg(content_sha256, chr(10) ORDER BY chunk_id)) AS body FROM (SELECT document_id, program || ' ' || curriculum_year || ' ' || edition_status AS label, chunk_id, content_sha256, row_number() OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS rn
    FROM chunk WHERE document_id IS NOT NULL AND program IS NOT NULL AND curriculum_year IS NOT NULL AND edition_status IS NOT NULL AND content_sha256 IS NOT NULL) WHERE rn <= 60 GROUP BY document_id, label""",
)
def prompt_units(spark: SparkSession, d: str) -> DataFrame:
    need = "document_id IS NOT NULL AND program IS NOT NULL AND curriculum_year IS NOT NULL AND edition_status IS NOT NULL AND content_sha256 IS NOT NULL"
    rows = table(spark, d, "chunk").filter(need).select("document_id", F.concat_ws(" ", "program", F.col("curriculum_year").cast("string"), "edition_status").alias("label"), "page_start", "chunk_id", "content_sha256")
    capped = cap_per_group(rows, ["document_id"], [F.asc("page_start"), F.asc("chunk_id")], 60)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "content_sha256"))), lambda x: x["content_sha256"]), "\n")
    return capped.groupBy("document_id", "label").agg(F.count("*").alias("units"), F.sha2(body, 256).alias("body"))
