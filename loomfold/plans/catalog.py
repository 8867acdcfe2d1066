"""Predefined and ad-hoc relational statements over versions, courses, documents, pages and chunks.

Each is one parameterised statement: filters and columns reach the scans,
grouping keys are explicit, every limit has a full order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import relational
from loomfold.plans.registry import Registry
from loomfold.sources.tables import table

R = Registry()

_VERSION = "(SELECT DISTINCT version_id, program, curriculum_year, edition_status FROM {document} WHERE version_id IS NOT NULL)"

#: Where a version comes from: its first document.
_SOURCE = "(SELECT version_id, MIN(relative_path) AS relative_path FROM {document} WHERE version_id IS NOT NULL GROUP BY version_id)"
_CODE = "(SELECT MIN(code) FROM {course} WHERE prerequisite_json <> '[]')"

R.statement(
    "course_credits",
    f"""SELECT c.course_id, c.code, c.name_th, c.name_en, c.credits_total, c.credits_lecture, c.credits_lab, c.credits_self_study,
    c.year, c.semester, v.program, v.curriculum_year, v.edition_status, s.relative_path
    FROM {{course}} c JOIN {_VERSION} v ON v.version_id = c.version_id JOIN {_SOURCE} s ON s.version_id = c.version_id WHERE c.code = {_CODE} ORDER BY v.program, v.curriculum_year, c.course_id""",
)
R.statement(
    "course_credits_of_edition",
    f"""SELECT c.course_id, c.code, c.name_th, c.credits_total, v.program, v.curriculum_year FROM {{course}} c JOIN {_VERSION} v ON v.version_id = c.version_id WHERE v.edition_status = :edition AND c.credits_total IS NOT NULL""",
    edition="current",
)
R.statement(
    "course_field",
    f"""SELECT c.course_id, c.code, f.field, CASE f.field WHEN 'credits' THEN c.credits_raw WHEN 'category' THEN c.category WHEN 'prerequisite' THEN c.prerequisite_raw ELSE c.note END AS value,
    v.program, s.relative_path FROM {{course}} c JOIN {_VERSION} v ON v.version_id = c.version_id JOIN {_SOURCE} s ON s.version_id = c.version_id
    JOIN (SELECT 'credits' AS field UNION ALL SELECT 'category' UNION ALL SELECT 'prerequisite' UNION ALL SELECT 'note') f ON f.field = :field WHERE v.edition_status = :edition""",
    field="category",
    edition="current",
)
R.statement(
    "course_by_name",
    """WITH n AS (SELECT name_en AS name FROM {course} WHERE name_en <> '' GROUP BY name_en HAVING COUNT(*) >= :least)
    SELECT c.course_id, c.code, c.version_id, c.name_th, c.name_en FROM {course} c JOIN n ON c.name_en = n.name
    UNION SELECT c.course_id, c.code, c.version_id, c.name_th, c.name_en FROM {course} c JOIN n ON c.name_th = n.name""",
    least=3,
)
R.statement(
    "plan_slot_courses",
    f"""SELECT v.version_id, v.program, c.year, c.semester, c.code, c.name_th, c.credits_total FROM {{course}} c JOIN {_VERSION} v ON v.version_id = c.version_id
    WHERE c.year = :year AND c.semester = :semester""",
    year=2,
    semester=1,
)
R.statement(
    "totals_by_category",
    f"""SELECT c.category, v.version_id, v.program, v.curriculum_year, v.edition_status, CAST(COUNT(*) AS BIGINT) AS n_courses, CAST(COALESCE(SUM(c.credits_total), 0) AS BIGINT) AS credits
    FROM {{course}} c JOIN {_VERSION} v ON v.version_id = c.version_id WHERE c.credits_total IS NOT NULL
    GROUP BY c.category, v.version_id, v.program, v.curriculum_year, v.edition_status""",
)
R.statement(
    "totals_by_slot",
    """SELECT version_id, year, semester, CAST(COUNT(*) AS BIGINT) AS n_courses, CAST(COALESCE(SUM(credits_total), 0) AS BIGINT) AS credits
    FROM {course} WHERE year IS NOT NULL AND semester IS NOT NULL GROUP BY version_id, year, semester""",
)
R.statement(
    "courses_by_type",
    "SELECT row_id, program, code, name_th, type FROM {bit_academic_plan_coop} WHERE type = :kind",
    kind="สหกิจศึกษา",
)
R.statement(
    "prerequisite_of_course",
    f"""SELECT c.course_id, c.code, c.prerequisite_raw, c.prerequisite_json, v.program, v.curriculum_year, s.relative_path FROM {{course}} c JOIN {_VERSION} v ON v.version_id = c.version_id JOIN {_SOURCE} s ON s.version_id = c.version_id
    WHERE c.code = {_CODE} AND c.prerequisite_json <> :none ORDER BY v.program, v.curriculum_year, c.course_id""",
    none="[]",
)
R.statement(
    "version_diff_rows",
    """SELECT version_id, code, name_th, credits_total FROM {course} WHERE version_id IN (:a, :b)""",
    a=1,
    b=2,
)
R.statement(
    "provenance_of_hash",
    """SELECT k.chunk_id, k.content_sha256, k.page_start, d.relative_path, p.page_id FROM {chunk} k JOIN {document} d ON d.document_id = k.document_id
    JOIN {page} p ON p.document_id = k.document_id AND p.page_number = k.page_start WHERE k.content_sha256 = (SELECT min(content_sha256) FROM {chunk})""",
)
R.statement(
    "document_list",
    """SELECT document_id, relative_path, page_count, program, curriculum_year, edition_status FROM {document} ORDER BY relative_path, document_id LIMIT :most""",
    most=500,
)
R.statement(
    "page_text",
    "SELECT document_id, page_number, page_text FROM {page} WHERE status = :status AND page_number = :page",
    status="page_complete",
    page=1,
)
R.statement(
    "chunks_of_versions",
    """SELECT chunk_id, heading, document_id, program, curriculum_year FROM {chunk} WHERE edition_status = :edition""",
    edition="current",
)
R.statement(
    "topic_keyword_search",
    """SELECT course_id, code, name_th, name_en, version_id FROM {course} WHERE name_th ILIKE :th OR name_en ILIKE :en""",
    th="%ข้อมูล%",
    en="%data%",
)
R.statement(
    "courses_of_year",
    "SELECT course_id, code, name_th, year, semester, credits_total FROM {course} WHERE year = :year ORDER BY semester, code, course_id LIMIT :most",
    year=3,
    most=200,
)
R.statement(
    "plan_page_of_heading",
    """SELECT document_id, MIN(page_number) AS page_number FROM {page} WHERE page_text LIKE :heading GROUP BY document_id""",
    heading="%แผนการศึกษา%",
)
R.statement(
    "prerequisite_candidates",
    """SELECT course_id, code, name_th, prerequisite_json FROM {course} WHERE name_en LIKE :word ORDER BY CASE WHEN prerequisite_json <> '[]' THEN 0 ELSE 1 END, course_id LIMIT 10""",
    word="%DATABASE%",
)
R.statement("unplanned_counts", "SELECT version_id, CAST(COUNT(*) AS BIGINT) AS n FROM {course} WHERE year IS NULL GROUP BY version_id")
R.statement("versions_by_year", "SELECT program, edition_status, MIN(curriculum_year) AS first_year, MAX(curriculum_year) AS last_year FROM {document} GROUP BY program, edition_status")
R.statement("pages_per_path", """SELECT d.path AS compute_path, CAST(COUNT(m.page_id) AS BIGINT) AS n FROM (SELECT 'fast' AS path UNION ALL SELECT 'standard' UNION ALL SELECT 'deep') d LEFT JOIN {page_metrics} m ON m.compute_path = d.path GROUP BY d.path""")
R.statement(
    "ocr_candidates",
    """SELECT p.page_id, d.relative_path, p.page_number, m.candidate_reason FROM {page} p JOIN {document} d ON d.document_id = p.document_id
    JOIN (SELECT page_id, MAX(candidate_reason) AS candidate_reason FROM {page_metrics} WHERE is_ocr_candidate GROUP BY page_id) m ON m.page_id = p.page_id""",
)
R.statement("canonical_pages", "SELECT p.page_id, p.document_id, p.page_number FROM {page} p JOIN {document} d ON d.document_id = p.document_id WHERE d.canonical_document_id = d.document_id AND p.status = :status", status="page_complete")
R.statement("closure_violations", """SELECT k.chunk_id, k.document_id FROM {chunk} k LEFT JOIN {page} p ON p.document_id = k.document_id AND p.page_number = k.page_start WHERE p.page_id IS NULL OR k.page_end < k.page_start""")
R.statement("incomplete_orders", """SELECT l_orderkey, CAST(COUNT(*) AS BIGINT) AS n FROM {lineitem} GROUP BY l_orderkey HAVING COUNT(*) <> :expected""", expected=4)
R.statement("orphan_orders", "SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l LEFT ANTI JOIN {orders} o ON o.o_orderkey = l.l_orderkey")
R.sql["orphan_orders"] = "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"
R.statement("unmeasured_pages", "SELECT p.page_id, p.document_id FROM {page} p LEFT ANTI JOIN {page_metrics} m ON m.page_id = p.page_id")
R.sql["unmeasured_pages"] = "SELECT p.page_id, p.document_id FROM page p WHERE NOT EXISTS (SELECT 1 FROM page_metrics m WHERE m.page_id = p.page_id)"
R.statement("customer_rules", """SELECT c.c_custkey, n.n_name, r.attribute, CASE WHEN c.c_acctbal >= r.least THEN true ELSE false END AS holds FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
    JOIN (SELECT 'BUILDING' AS segment, 'balance' AS attribute, 0.0 AS least UNION ALL SELECT 'MACHINERY', 'balance', 1000.0) r ON r.segment = c.c_mktsegment""")
R.statement("table_counts", "SELECT 'document' AS name, CAST(COUNT(*) AS BIGINT) AS n FROM {document} UNION ALL SELECT 'page', COUNT(*) FROM {page} UNION ALL SELECT 'chunk', COUNT(*) FROM {chunk} UNION ALL SELECT 'course', COUNT(*) FROM {course} UNION ALL SELECT 'stage_result', COUNT(*) FROM {stage_result}")
R.statement("page_totals", "SELECT CAST(COUNT(*) AS BIGINT) AS documents, CAST(COALESCE(SUM(page_count), 0) AS BIGINT) AS pages FROM {document}")


@R.add("chunks_with_code", "SELECT chunk_id, document_id FROM chunk WHERE regexp_matches(content_text, '[0-9]{8}')")
def chunks_with_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter(F.col("content_text").rlike("[0-9]{8}")).select("chunk_id", "document_id")


@R.add(
    "best_version_per_program",
    """SELECT program, version_id, n_planned FROM (SELECT program, version_id, CAST(COUNT(year) AS BIGINT) AS n_planned,
    ROW_NUMBER() OVER (PARTITION BY program ORDER BY COUNT(year) DESC, MAX(curriculum_year) DESC, version_id) AS rn
    FROM course WHERE edition_status = 'current' GROUP BY program, version_id) WHERE rn = 1""",
)
def best_version_per_program(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "course").filter("edition_status = 'current'").groupBy("program", "version_id").agg(F.count("year").alias("n_planned"), F.max("curriculum_year").alias("y"))
    return relational.first_per_group(counted, ["program"], [F.desc("n_planned"), F.desc("y"), F.asc("version_id")]).select("program", "version_id", "n_planned")


@R.add(
    "name_diff_both_ways",
    """WITH n AS (SELECT DISTINCT version_id, lower(regexp_replace(name_th, '[ \\t]', '', 'g')) AS k FROM course WHERE version_id IN (1, 2) AND name_th IS NOT NULL)
    SELECT 'removed' AS side, k FROM (SELECT k FROM n WHERE version_id = 1 EXCEPT SELECT k FROM n WHERE version_id = 2)
    UNION ALL SELECT 'added', k FROM (SELECT k FROM n WHERE version_id = 2 EXCEPT SELECT k FROM n WHERE version_id = 1)""",
)
def name_diff_both_ways(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "course").filter("name_th IS NOT NULL").select("version_id", F.lower(F.regexp_replace("name_th", "[ \\t]", "")).alias("k"))
    return relational.difference_both_ways(names.filter("version_id = 1").select("k"), names.filter("version_id = 2").select("k"), "k", "removed", "added")


@R.add(
    "prerequisite_names",
    """WITH e AS (SELECT DISTINCT source_path, code, unnest(prerequisite_codes) AS pre FROM normalized_course),
    own AS (SELECT source_path, code, MIN(name_th) AS name FROM normalized_course GROUP BY 1, 2), everywhere AS (SELECT code, MIN(name_th) AS name FROM normalized_course GROUP BY 1)
    SELECT e.source_path, e.code, e.pre, COALESCE(own.name, everywhere.name) AS name FROM e LEFT JOIN own ON own.source_path = e.source_path AND own.code = e.pre LEFT JOIN everywhere ON everywhere.code = e.pre WHERE e.pre IS NOT NULL""",
)
def prerequisite_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "normalized_course")
    edges = rows.select("source_path", "code", F.explode("prerequisite_codes").alias("pre")).filter("pre IS NOT NULL").distinct()
    own = rows.groupBy("source_path", F.col("code").alias("pre")).agg(F.min("name_th").alias("own"))
    anywhere = rows.groupBy(F.col("code").alias("pre")).agg(F.min("name_th").alias("any"))
    return relational.lookup_with_fallback(edges, own, ["source_path", "pre"], anywhere, ["pre"], "own", "any", "name").select("source_path", "code", "pre", "name")


@R.add(
    "code_index",
    """SELECT code, CAST(COUNT(*) AS BIGINT) AS n, CAST(COUNT(DISTINCT source_path) AS BIGINT) AS n_files FROM
    (SELECT DISTINCT source_path, r, code FROM (SELECT source_path, r, unnest(list_concat([code], COALESCE(alternative_codes, []))) AS code FROM (SELECT *, row_number() OVER () AS r FROM normalized_course))) WHERE code IS NOT NULL GROUP BY code""",
)
def code_index(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array_distinct(F.concat(F.array("code"), F.coalesce("alternative_codes", F.array().cast("array<string>"))))
    rows = table(spark, d, "normalized_course").select("source_path", F.explode(codes).alias("code")).filter("code IS NOT NULL")
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("source_path").alias("n_files"))


@R.add(
    "page_upsert",
    """SELECT page_id, extracted_char_count, compute_path FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY COALESCE(extracted_char_count, -1) DESC, COALESCE(compute_path, '') DESC) AS rn FROM page_metrics) WHERE rn = 1""",
)
def page_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_metrics").select("page_id", "extracted_char_count", "compute_path")
    order = [F.desc(F.coalesce("extracted_char_count", F.lit(-1))), F.desc(F.coalesce("compute_path", F.lit("")))]
    return relational.first_per_group(rows, ["page_id"], order)


@R.add(
    "duplicate_documents",
    """SELECT document_id, sha256, FIRST_VALUE(document_id) OVER (PARTITION BY sha256 ORDER BY relative_path, document_id) AS canonical_id, CAST(COUNT(*) OVER (PARTITION BY sha256) AS BIGINT) AS copies FROM document""",
)
def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    return relational.canonical_by(table(spark, d, "document").select("document_id", "sha256", "relative_path"), "sha256", "document_id", "relative_path").select("document_id", "sha256", "canonical_id", "copies")


@R.add(
    "manifest_nested",
    """SELECT d.document_id, d.relative_path, CAST(COUNT(c.document_id) AS BIGINT) AS n_copies, COALESCE(string_agg(c.relative_path, '|' ORDER BY c.relative_path), '') AS copies
    FROM document d LEFT JOIN document c ON c.canonical_document_id = d.document_id AND c.document_id <> d.document_id GROUP BY d.document_id, d.relative_path""",
)
def manifest_nested(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "document")
    copies = docs.filter("canonical_document_id <> document_id").groupBy(F.col("canonical_document_id").alias("document_id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("relative_path")).alias("paths"))
    return docs.select("document_id", "relative_path").join(copies, "document_id", "left").select(
        "document_id", "relative_path", F.coalesce("n", F.lit(0)).alias("n_copies"), F.coalesce(F.array_join("paths", "|"), F.lit("")).alias("copies")
    )


@R.add(
    "resume_pages",
    "SELECT page_id, document_id FROM page WHERE completed_at IS NULL OR status <> 'page_complete'",
)
def resume_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page").select("page_id", "document_id", "status", "completed_at")
    return relational.not_yet(pages, pages.filter("status = 'page_complete' AND completed_at IS NOT NULL"), ["page_id"]).select("page_id", "document_id")


@R.add(
    "chunk_insert_if_absent",
    """SELECT MIN(chunk_id) AS chunk_id, content_sha256, program, curriculum_year, edition_status FROM chunk WHERE content_sha256 IS NOT NULL GROUP BY content_sha256, program, curriculum_year, edition_status""",
)
def chunk_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    key = ["content_sha256", "program", "curriculum_year", "edition_status"]
    rows = table(spark, d, "chunk").filter("content_sha256 IS NOT NULL").groupBy(*key).agg(F.min("chunk_id").alias("chunk_id"))
    return rows.select("chunk_id", *key)


@R.add(
    "version_upsert",
    """SELECT DISTINCT c.program, c.curriculum_year, c.edition_status FROM course c WHERE NOT EXISTS (SELECT 1 FROM document d WHERE d.program = c.program AND d.curriculum_year = c.curriculum_year AND d.edition_status = c.edition_status)
    UNION SELECT DISTINCT program, curriculum_year, edition_status FROM document""",
)
def version_upsert(spark: SparkSession, d: str) -> DataFrame:
    key = ["program", "curriculum_year", "edition_status"]
    held = table(spark, d, "document").select(*key).distinct()
    return held.unionByName(relational.not_yet(table(spark, d, "course").select(*key).distinct(), held, key))


@R.add(
    "credits_by_category_once",
    """SELECT program, category, CAST(SUM(credits_total) AS BIGINT) AS credits, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY program, category, code ORDER BY course_id) AS rn FROM course WHERE credits_total IS NOT NULL AND category IS NOT NULL) WHERE rn = 1 GROUP BY program, category""",
)
def credits_by_category_once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "course").filter("credits_total IS NOT NULL AND category IS NOT NULL").select("program", "category", "code", "course_id", "credits_total")
    once = relational.first_per_group(rows, ["program", "category", "code"], [F.asc("course_id")])
    return once.groupBy("program", "category").agg(F.sum("credits_total").alias("credits"), F.count("*").alias("n"))


@R.add(
    "credits_report",
    """SELECT program, category, CAST(SUM(credits_total) AS BIGINT) AS credits, GROUPING(program) AS g_program, GROUPING(category) AS g_category FROM course WHERE category IS NOT NULL AND program IS NOT NULL GROUP BY ROLLUP (program, category)""",
)
def credits_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "course").filter("category IS NOT NULL AND program IS NOT NULL")
    return rows.rollup("program", "category").agg(F.sum("credits_total").alias("credits"), F.grouping("program").cast("long").alias("g_program"), F.grouping("category").cast("long").alias("g_category"))


@R.add(
    "capped_candidates",
    """SELECT program, course_id, score FROM (SELECT program, course_id, CAST(score AS BIGINT) AS score, ROW_NUMBER() OVER (PARTITION BY program ORDER BY score DESC, course_id) AS rn FROM
    (SELECT program, course_id, MAX(score) AS score FROM (SELECT program, course_id, 2 AS score FROM course WHERE name_en LIKE '%DATABASE%' UNION ALL SELECT program, course_id, 1 FROM course WHERE name_th LIKE '%ข้อมูล%') GROUP BY program, course_id)) WHERE rn <= 18""",
)
def capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "course").select("program", "course_id", "name_en", "name_th")
    a = rows.filter("name_en LIKE '%DATABASE%'").select("program", "course_id", F.lit(2).cast("long").alias("score"))
    b = rows.filter("name_th LIKE '%ข้อมูล%'").select("program", "course_id", F.lit(1).cast("long").alias("score"))
    return relational.cap_per_group(relational.union_best(a, b, ["program", "course_id"], "score"), ["program"], [F.desc("score"), F.asc("course_id")], 18)


@R.add(
    "unique_violations",
    "SELECT source_path, code, CAST(COUNT(*) AS BIGINT) AS n FROM normalized_course GROUP BY source_path, code HAVING COUNT(*) > 1",
)
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicates(table(spark, d, "normalized_course"), ["source_path", "code"])


@R.add(
    "range_violations",
    """SELECT page_id, 'out_of_charset_ratio' AS field FROM page_metrics WHERE out_of_charset_ratio < 0 OR out_of_charset_ratio > 1
    UNION ALL SELECT page_id, 'extracted_char_count' FROM page_metrics WHERE extracted_char_count < 0
    UNION ALL SELECT page_id, 'image_area_ratio' FROM page_metrics WHERE image_area_ratio < 0 OR image_area_ratio > 1""",
)
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    return relational.range_violations(table(spark, d, "page_metrics"), "page_id", {"out_of_charset_ratio": (0, 1), "extracted_char_count": (0, None), "image_area_ratio": (0, 1)})
