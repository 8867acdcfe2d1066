"""Queries on structured answers, routing, evidence, citations and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.functions.text import leading_int
from loomfold.operators import answers, evidence, questions
from loomfold.plans.registry import Registry
from loomfold.sources.tables import table

R = Registry()
PROGRAMS = ("BIT", "CGT", "HIX", "MDA", "NIS", "SEQ")
_TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"
_CODES = "list_filter(" + _TOKENS + ", lambda t: regexp_full_match(t, '[0-9]{{8}}'))"


def codes_sql(text: str) -> str:
    """SQL for the codes of a text in order: its words that are eight digits."""
    return _CODES.format(text)


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


R.statement("version_by_program_year", "SELECT DISTINCT version_id, edition_status FROM {course} WHERE program = :program AND curriculum_year = :year ORDER BY version_id LIMIT 1", program="BIT", year=2566)
R.statement("version_by_id", "SELECT DISTINCT program, curriculum_year, edition_status FROM {course} WHERE version_id = :id", id=7)
R.statement("unplanned_courses", "SELECT course_id, code, name_th, credits_total FROM {course} WHERE version_id = :id AND year IS NULL", id=3)
R.statement("current_year", "SELECT program, max(curriculum_year) AS year FROM {document} WHERE edition_status = 'current' AND program IS NOT NULL GROUP BY program")
R.statement(
    "candidate_chunks",
    "SELECT chunk_id, document_id FROM {chunk} WHERE edition_status = 'current' AND (content_text LIKE '%หน่วยกิต%' OR heading LIKE '%หน่วยกิต%' OR content_text LIKE '%ปีที่%' OR heading LIKE '%ปีที่%') ORDER BY chunk_id LIMIT 800",
)
R.statement("candidate_total", "SELECT count(DISTINCT page_id) AS n FROM {page_metrics} WHERE is_ocr_candidate")
R.statement(
    "rules_diff",
    """SELECT COALESCE(a.category, b.category) AS category, a.total AS total_a, b.total AS total_b FROM (SELECT category, sum(credits_total) AS total FROM {course} WHERE version_id = :a AND category IS NOT NULL GROUP BY category) a
    FULL OUTER JOIN (SELECT category, sum(credits_total) AS total FROM {course} WHERE version_id = :b AND category IS NOT NULL GROUP BY category) b ON a.category = b.category WHERE a.total IS DISTINCT FROM b.total""",
    a=2, b=3,
)
R.statement(
    "early_graduation",
    """SELECT version_id, sum(CASE WHEN year = 4 AND semester = 2 THEN 1 ELSE 0 END) AS last_courses, sum(CASE WHEN year = 4 AND semester = 2 THEN COALESCE(credits_total, 0) ELSE 0 END) AS last_credits,
    sum(CASE WHEN year IS NOT NULL AND semester IS NOT NULL AND NOT (year = 4 AND semester = 2) THEN COALESCE(credits_total, 0) ELSE 0 END) AS other_credits, sum(CASE WHEN year IS NULL THEN COALESCE(credits_total, 0) ELSE 0 END) AS free_credits FROM {course} WHERE version_id IS NOT NULL GROUP BY version_id""",
)
R.statement(
    "plan_summary",
    """SELECT version_id, year, semester, count(*) AS courses, sum(COALESCE(credits_total, 0)) AS credits, sum(sum(COALESCE(credits_total, 0))) OVER (PARTITION BY version_id ORDER BY year, semester) AS credits_so_far
    FROM {course} WHERE version_id IS NOT NULL AND year IS NOT NULL AND semester IS NOT NULL GROUP BY version_id, year, semester""",
)
R.statement(
    "version_with_plan",
    """SELECT program, version_id, n_plan FROM (SELECT v.program, v.version_id, v.n_plan, row_number() OVER (PARTITION BY v.program ORDER BY v.n_plan DESC, v.curriculum_year DESC, v.version_id) AS rn
    FROM (SELECT program, version_id, curriculum_year, count(year) AS n_plan FROM {course} WHERE edition_status = 'current' AND program <> :legacy AND version_id IS NOT NULL GROUP BY program, version_id, curriculum_year) v) x WHERE rn = 1""",
    legacy="BIT",
)
R.statement(
    "quota_issues",
    """SELECT page_id, CASE WHEN chars = 0 THEN 'low_content' WHEN used > :quota THEN 'ocr_budget_exhausted' END AS issue FROM (SELECT page_id, length(page_text) AS chars, sum(CASE WHEN length(page_text) BETWEEN 1 AND 119 THEN 1 ELSE 0 END) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
    FROM {page} WHERE page_text IS NOT NULL AND length(page_text) < 120) x WHERE chars = 0 OR used > :quota""",
    quota=20,
)
R.statement("page_restart", "SELECT page_id, CASE WHEN completed_at IS NULL THEN 'pending' ELSE status END AS status, CASE WHEN completed_at IS NULL THEN NULL ELSE page_sha256 END AS page_sha256 FROM {page}")
R.statement(
    "canonical_pages_measured",
    """SELECT p.page_id, m.score FROM {page} p JOIN {document} d ON d.document_id = p.document_id LEFT JOIN (SELECT page_id, max(page_quality_score) AS score FROM {page_metrics} WHERE page_quality_score BETWEEN 0 AND 1 GROUP BY page_id) m ON m.page_id = p.page_id WHERE d.canonical_document_id = d.document_id""",
)
R.statement("incomplete_versions", "SELECT document_id FROM {document} WHERE COALESCE(trim(program), '') = '' OR curriculum_year IS NULL OR COALESCE(trim(edition_status), '') = ''")
R.statement("bad_hashes", "SELECT document_id, sha256 FROM {document} WHERE sha256 IS NULL OR length(sha256) <> 64 OR lower(sha256) <> sha256 OR length(translate(sha256, '0123456789abcdef', '')) > 0")
R.statement(
    "drift_from_baseline",
    """SELECT event_id, user_id, value - nth_value(value, 5) OVER w AS drift, max(value) OVER w AS peak FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
R.statement("renumbered_stages", "SELECT stage_result_id, region_id, row_number() OVER (PARTITION BY region_id ORDER BY stage_index, stage_result_id) - 1 AS ord FROM {stage_result} WHERE text <> ''")
R.statement(
    "leader_of_user",
    "SELECT user_id, value AS best, value > COALESCE(second, value - 1) AS leads FROM (SELECT user_id, value, lead(value) OVER w AS second, row_number() OVER w AS rn FROM {events} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) x WHERE rn = 1",
)
R.statement("stage_confidence", "SELECT page_id, avg(confidence) AS mean, median(quality_score) AS middle FROM {stage_result} WHERE page_id IS NOT NULL GROUP BY page_id")
R.statement("snippets", "SELECT chunk_id, substring(content_text, 1, 500) AS snippet, length(content_text) AS size FROM {chunk}")
R.statement("errors_by_reason", "SELECT candidate_reason, count(*) AS n FROM {page_metrics} WHERE candidate_reason IS NOT NULL GROUP BY candidate_reason ORDER BY candidate_reason")


@R.add("plan_order", "SELECT course_id, CAST(row_number() OVER (PARTITION BY version_id ORDER BY COALESCE(NULLIF(year, 0), 9), COALESCE(NULLIF(semester, 0), 9), code NULLS FIRST, course_id) AS INTEGER) AS ord FROM course")
def plan_order(spark: SparkSession, d: str) -> DataFrame:
    return questions.plan_order(table(spark, d, "course").select("course_id", "version_id", "year", "semester", "code"), ["version_id"]).select("course_id", "ord")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("chunk_id", "heading")


_YEAR = "COALESCE(TRY_CAST(NULLIF(regexp_extract(heading, 'ปี(?:ที่)?\\s*([1-4])', 1), '') AS INTEGER), CASE WHEN regexp_matches(heading, 'ปี(?:ที่)?หนึ่ง') THEN 1 WHEN regexp_matches(heading, 'ปี(?:ที่)?สอง') THEN 2 WHEN regexp_matches(heading, 'ปี(?:ที่)?สาม') THEN 3 WHEN regexp_matches(heading, 'ปี(?:ที่)?สี่') THEN 4 END)"
_PROGRAM = "CASE " + " ".join(f"WHEN regexp_matches(upper(heading), '(^|[^A-Z]){p}([^A-Z]|$)') THEN '{p}'" for p in sorted(PROGRAMS, key=lambda x: (-len(x), [-ord(c) for c in x]))) + " END"
_INTENT = (
    "CASE " + " ".join(f"WHEN {_any('lower(heading)', w)} THEN '{k}'" for k, w in questions.INTENTS.items())
    + f" WHEN {_YEAR} IS NOT NULL THEN 'course_by_year' WHEN {_any('heading', questions.ALL_WORDS)} THEN 'all_courses' WHEN contains(heading, 'วิชา') THEN 'topic_courses' ELSE 'general' END"
)
_SEMESTER = "CASE WHEN contains(heading, 'ภาคต้น') OR contains(heading, 'เทอมต้น') THEN 1 WHEN contains(heading, 'ภาคปลาย') OR contains(heading, 'เทอมปลาย') THEN 2 END"


@R.add("question_parse", f"SELECT chunk_id, {_INTENT} AS intent, {_PROGRAM} AS program, {_YEAR} AS year, {_SEMESTER} AS semester FROM chunk WHERE heading IS NOT NULL")
def question_parse(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).filter("heading IS NOT NULL").select("chunk_id", questions.parse(F.col("heading"), PROGRAMS).alias("p")).select("chunk_id", "p.*")


@R.add(
    "question_reply",
    f"""WITH q AS (SELECT *, chunk_id % 4 AS k FROM chunk WHERE heading IS NOT NULL)
    SELECT chunk_id, CASE k WHEN 0 THEN 'prerequisite' WHEN 1 THEN 'general' ELSE {_INTENT} END AS intent, CASE k WHEN 0 THEN 'NIS' ELSE {_PROGRAM} END AS program, CASE k WHEN 0 THEN 3 ELSE {_YEAR} END AS year, {_SEMESTER} AS semester, CASE k WHEN 0 THEN 'data' END AS topic FROM q""",
)
def question_reply(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a stub: a whole one, one with invalid values, one without an object, none."""
    reply = F.element_at(F.array(F.lit('so: {"intent": "prerequisite", "program": "nis", "year": 3, "topic": " data "}'), F.lit('{"intent": "weather", "program": "XX", "year": 9, "topic": "null"}'), F.lit("cannot say"), F.lit(None).cast("string")), (F.col("chunk_id") % 4 + 1).cast("int"))
    return _headings(spark, d).filter("heading IS NOT NULL").select("chunk_id", questions.parse_reply(reply, F.col("heading"), PROGRAMS).alias("p")).select("chunk_id", "p.*")


_WORD = "[A-Za-z]{2,4}[0-9]{4,6}"
_N = f"(len({codes_sql('heading')}) + len(list_filter({_TOKENS.format('heading')}, lambda t: regexp_full_match(t, '{_WORD}'))))"
_L = "lower(trim(heading))"


@R.add(
    "question_route",
    f"""WITH q AS (SELECT chunk_id, heading, {_N} AS codes, {_any(_L, answers.COMPARE_WORDS)} AS c, {_any(_L, answers.RELATION_WORDS)} AS r, {_any(_L, answers.LIST_WORDS)} AS l, {_any(_L, answers.FIELD_WORDS)} AS f,
    len(list_distinct(list_filter({_TOKENS.format('heading')}, lambda t: regexp_full_match(t, '25(6[0-9]|7[0-9])')))) AS y FROM chunk WHERE length(trim(heading)) BETWEEN 1 AND 500),
    v AS (SELECT chunk_id, codes, heading, CASE WHEN c AND y >= 2 THEN ['L4', '0.9', 'R4_comparison_multi_version'] WHEN c THEN ['L4', '0.7', 'R4_comparison_implicit_version'] WHEN r AND codes >= 1 THEN ['L3', '0.85', 'R3_relationship_with_code'] WHEN r THEN ['L3', '0.7', 'R3_relationship_general']
    WHEN codes = 1 AND f AND NOT l THEN ['L1', '0.9', 'R1_single_code_single_field'] WHEN l AND codes = 0 THEN ['L2', '0.85', 'R2_aggregation_no_code'] WHEN l THEN ['L2', '0.75', 'R2_aggregation_with_codes'] WHEN codes = 1 THEN ['L1', '0.65', 'R1_single_code_implicit_field'] ELSE ['L3', '0.4', 'router_fallback(R_default_uncertain)'] END AS x FROM q),
    n AS (SELECT v.chunk_id, count(k.code) AS found FROM (SELECT chunk_id, unnest({codes_sql('heading')}) AS code FROM v) v LEFT JOIN (SELECT DISTINCT code FROM course) k ON k.code = v.code GROUP BY 1),
    z AS (SELECT v.chunk_id, x, x[1] IN ('L1', 'L2') AS s, x[1] IN ('L1', 'L2') AND COALESCE(n.found = 0, false) AS e FROM v LEFT JOIN n ON n.chunk_id = v.chunk_id)
    SELECT chunk_id, CASE WHEN e THEN 'L3' ELSE x[1] END AS level, CAST(x[2] AS DOUBLE) AS confidence, CASE WHEN e THEN 'route_escalated(' || x[3] || ')' ELSE x[3] END AS rule, CASE WHEN s AND NOT e THEN 'structured' ELSE 'evidence_planner' END AS path, x[2] = '0.4' AS fallback, e AS escalated FROM z""",
)
def question_route(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the headings; a heading that names courses asks the course table, and goes on to the evidence where that has none of them."""
    rows = _headings(spark, d)
    named = rows.select("chunk_id", F.explode(F.regexp_extract_all("heading", F.lit(f"({answers.CODE})"), F.lit(1))).alias("code"))
    known = table(spark, d, "course").select("code", F.lit(1).alias("one")).distinct()
    found = named.join(known, "code", "left").groupBy("chunk_id").agg(F.count("one").alias("found"))
    routed = rows.join(found, "chunk_id", "left").select("chunk_id", questions.route(F.col("heading"), F.col("found"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("r"))
    return routed.filter("r.valid").select("chunk_id", "r.level", "r.confidence", "r.rule", "r.path", "r.fallback", "r.escalated")


@R.add(
    "question_semester",
    "SELECT doc_id, CASE WHEN contains(text, 'ภาคต้น') OR contains(text, 'เทอมต้น') OR contains(text, 'เทอมแรก') THEN 1 WHEN contains(text, 'ภาคปลาย') OR contains(text, 'เทอมปลาย') THEN 2 ELSE TRY_CAST(NULLIF(regexp_extract(text, '(?:เทอม|ภาค(?:การศึกษา)?(?:ที่)?)\\s*([1-3])', 1), '') AS INTEGER) END AS semester FROM documents WHERE text IS NOT NULL",
)
def question_semester(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", answers.study_semester(F.col("text")).alias("semester"))


@R.add("leading_numbers", "SELECT row_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(credits, '^\\s*(\\d{1,9})', 1), '') AS INTEGER), 0) AS n FROM bit_academic_plan_coop WHERE credits IS NOT NULL")
def leading_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bit_academic_plan_coop").filter("credits IS NOT NULL").select("row_id", leading_int(F.col("credits")).alias("n"))


@R.add("topic_words")
def topic_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("heading IS NOT NULL")
    return rows.select("chunk_id", F.array_join(questions.topic_keywords(F.col("heading"), F.col("program")), "|").alias("words"))


@R.add(
    "escaped_terms",
    """SELECT chunk_id, array_to_string(list_transform(list_filter(regexp_split_to_array(translate(heading, '*"()^{}:+-~\\', '            '), '\\s+'), lambda t: t <> ''), lambda t: '"' || t || '"'), ' ') AS terms FROM chunk WHERE heading IS NOT NULL""",
)
def escaped_terms(spark: SparkSession, d: str) -> DataFrame:
    return _headings(spark, d).filter("heading IS NOT NULL").select("chunk_id", F.array_join(questions.escaped_terms(F.col("heading")), " ").alias("terms"))


@R.add(
    "stem_ranking",
    """WITH w AS (SELECT course_id, unnest(regexp_extract_all(lower(COALESCE(name_th, '') || ' ' || COALESCE(name_en, '')), '([ก-๙]+|[a-z]+)')) AS w FROM course), k AS (SELECT unnest(['networking', 'systems', 'law']) AS k),
    h AS (SELECT course_id, count(DISTINCT k) AS hits FROM w, k WHERE CASE WHEN least(length(k), length(w)) < 4 THEN contains(k, w) OR contains(w, k) ELSE left(k, least(5, length(k), length(w))) = left(w, least(5, length(k), length(w))) END GROUP BY course_id)
    SELECT course_id, CAST(hits AS INTEGER) AS hits, hits = (SELECT max(hits) FROM h) AND (SELECT count(*) FROM h WHERE hits = (SELECT max(hits) FROM h)) = 1 AS leads FROM h""",
)
def stem_ranking(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws(" ", F.coalesce("name_th", F.lit("")), F.coalesce("name_en", F.lit("")))
    return questions.rank_by_stems(table(spark, d, "course"), "course_id", name, ["networking", "systems", "law"])


@R.add("elective_slots")
def elective_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter(F.col("content_text").contains("ปีที่ 4 ภาคการศึกษาที่ 1"))
    return rows.select("chunk_id", F.array_join(questions.elective_slots(F.col("content_text"), 4, 1), "|").alias("slots"))


@R.add("foreign_institutions")
def foreign_institutions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stage_result").select("stage_result_id", questions.foreign_institution(F.col("text"), "สถาบันตัวอย่าง").alias("name")).filter("name IS NOT NULL")


@R.add(
    "evidence_nodes",
    """WITH c AS (SELECT document_id, chunk_id, content_sha256 AS node, (chunk_id % 3) AS hop, page_start, edition_status, heading, content_text FROM chunk WHERE document_id IS NOT NULL),
    a AS (SELECT *, CASE WHEN page_start IS NULL OR heading IS NULL THEN 'missing_provenance' WHEN NOT COALESCE(edition_status = 'current', false) THEN 'other_version' END AS w1 FROM c),
    b AS (SELECT *, CASE WHEN w1 IS NULL AND row_number() OVER (PARTITION BY document_id, node, w1 IS NULL ORDER BY hop, chunk_id) > 1 THEN 'duplicate' ELSE w1 END AS w2 FROM a),
    e AS (SELECT *, CASE WHEN w2 IS NULL AND count(CASE WHEN w2 IS NULL THEN 1 END) OVER (PARTITION BY document_id, hop ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 10 THEN 'hop_full' ELSE w2 END AS w3 FROM b),
    g AS (SELECT *, CASE WHEN w3 IS NULL AND count(CASE WHEN w3 IS NULL THEN 1 END) OVER (PARTITION BY document_id ORDER BY hop, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 25 THEN 'full' ELSE COALESCE(w3, 'taken') END AS verdict FROM e)
    SELECT document_id, verdict, count(*) AS n FROM g GROUP BY ALL""",
)
def evidence_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("document_id IS NOT NULL").select("document_id", "chunk_id", F.col("content_sha256").alias("node"), (F.col("chunk_id") % 3).alias("hop"), "page_start", "heading", "edition_status")
    taken = evidence.admit_nodes(rows, "document_id", "node", "hop", ["chunk_id"], ["page_start", "heading"], F.col("edition_status") == "current", most=25)
    return taken.groupBy("document_id", "verdict").agg(F.count("*").alias("n"))


@R.add("evidence_edges")
def evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of each plan file taken one after another, without those that close a circle."""
    from loomfold.operators import hierarchy

    edges = hierarchy.links(table(spark, d, "normalized_course"), "source_path", "code", "prerequisite_codes")[0]
    return evidence.acyclic_edges(edges.withColumn("at", F.concat_ws(">", "node", "parent")), "grp", "node", "parent", "at").select("grp", "node", "parent", "taken")


@R.add(
    "cascade_runs",
    """WITH s AS (SELECT region_id, stage_index, confidence, COALESCE(max(CASE WHEN confidence >= 0.9 THEN 1 ELSE 0 END) OVER w, 0) = 0 AND COALESCE(sum(elapsed_ms) OVER w, 0) < 2000 AS run FROM stage_result WINDOW w AS (PARTITION BY region_id ORDER BY stage_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT region_id, stage_index, run, run AND row_number() OVER (PARTITION BY region_id ORDER BY run DESC, COALESCE(confidence, -1) DESC, stage_index) = 1 AS chosen FROM s""",
)
def cascade_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_result").select("region_id", "stage_index", "confidence", "elapsed_ms")
    return evidence.cascade(rows, "region_id", "stage_index", "confidence", "elapsed_ms", 0.9, 2000)


@R.add(
    "trace_violations",
    """WITH t AS (SELECT CAST(region_id AS VARCHAR) AS request_id, engine, confidence, CASE WHEN cache_hit THEN 1 ELSE 0 END AS ocr FROM stage_result)
    SELECT request_id, 'no engine' AS problem FROM t WHERE engine IS NULL UNION ALL SELECT request_id, 'no confidence' FROM t WHERE confidence IS NULL UNION ALL SELECT request_id, 'scan' FROM t WHERE ocr <> 0 UNION ALL SELECT request_id, 'repeated' FROM t GROUP BY request_id HAVING count(*) > 1""",
)
def trace_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_result").select(F.col("region_id").cast("string").alias("request_id"), "engine", "confidence", F.col("cache_hit").cast("int").alias("ocr_invocations"))
    return evidence.trace_violations(rows, "request_id", ["engine", "confidence"])


_ISSUED = "SELECT document_id, chunk_id, program, curriculum_year, 'cite-' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_start NULLS FIRST, chunk_id) AS VARCHAR), 3, '0') AS citation_id FROM chunk WHERE document_id IS NOT NULL"


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An answer a document that cites its first forty citations, and the citations that its chunks were issued."""
    rows = table(spark, d, "chunk").filter("document_id IS NOT NULL").select("document_id", "chunk_id", "page_start", "program", "curriculum_year")
    issued = answers.issue_citations(rows, ["document_id"], [F.asc("page_start"), F.asc("chunk_id")]).drop("page_start")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.format_string("see [cite-%03d]", i)), " ")
    return rows.select("document_id").distinct().withColumn("answer", text), issued


@R.add("citations_resolved", f"SELECT x.document_id, x.citation_id, i.chunk_id, i.chunk_id IS NOT NULL AS known FROM (SELECT document_id, 'cite-' || lpad(CAST(n AS VARCHAR), 3, '0') AS citation_id FROM (SELECT DISTINCT document_id FROM chunk WHERE document_id IS NOT NULL), range(1, 41) r(n)) x LEFT JOIN ({_ISSUED}) i USING (document_id, citation_id)")
def citations_resolved(spark: SparkSession, d: str) -> DataFrame:
    given, issued = _cited(spark, d)
    return answers.resolve_citations(given, "document_id", issued).select("document_id", "citation_id", "chunk_id", "known")


@R.add("citations_foreign", f"SELECT document_id, citation_id FROM ({_ISSUED}) i WHERE TRY_CAST(citation_id[6:] AS INTEGER) <= 40 AND NOT EXISTS (SELECT 1 FROM document v WHERE v.document_id = i.document_id AND v.program = i.program AND v.curriculum_year = i.curriculum_year)")
def citations_foreign(spark: SparkSession, d: str) -> DataFrame:
    given, issued = _cited(spark, d)
    return answers.foreign_citations(given, "document_id", issued, table(spark, d, "document"), ["program", "curriculum_year"])


_FOUND = """SELECT doc_id, line, regexp_extract(x, '(?:^|[^\\p{L}\\p{N}_])([0-9]{8})(?:$|[^\\p{L}\\p{N}_])', 1) AS code, x, last_value(NULLIF(regexp_extract(x, 'ปีที่\\s*([0-9])\\s*ภาคการศึกษาที่\\s*[0-9]', 1), '') IGNORE NULLS) OVER w AS year,
    last_value(NULLIF(regexp_extract(x, 'ปีที่\\s*[0-9]\\s*ภาคการศึกษาที่\\s*([0-9])', 1), '') IGNORE NULLS) OVER w AS semester FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_NAMED = f"""SELECT doc_id, CAST(line AS INTEGER) AS line, code, regexp_replace(regexp_extract(regexp_replace(x[instr(x, code) + 8:], '^\\s+', ''), '^([ก-๙\\s\\-/().]+)', 1), '\\s+$', '') AS name, regexp_extract(x, '[0-9]\\s*\\([0-9]-[0-9]-[0-9]+\\)') AS credits, CAST(year AS INTEGER) AS year, CAST(semester AS INTEGER) AS semester FROM ({_FOUND}) WHERE code <> ''"""


@R.add("evidence_courses", f"SELECT * FROM ({_NAMED}) WHERE length(name) > 3")
def evidence_courses(spark: SparkSession, d: str) -> DataFrame:
    return answers.evidence_courses(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")


@R.add(
    "missing_courses",
    f"""WITH f AS (SELECT * FROM ({_NAMED}) WHERE length(name) > 3), a AS (SELECT doc_id, unnest({codes_sql("CASE WHEN instr(text, chr(10)) > 0 THEN split_part(text, chr(10), 1) ELSE text END")}) AS code FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, code, arg_min(name, line) AS name FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = f.doc_id AND a.code = f.code) GROUP BY doc_id, code""",
)
def missing_courses(spark: SparkSession, d: str) -> DataFrame:
    """Each text is the evidence, its first line stands for the answer."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    found = answers.evidence_courses(docs, "doc_id", "text")
    return answers.missing_courses(found, docs.select("doc_id", F.substring_index("text", "\n", 1).alias("answer")), "doc_id", "answer")


_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@R.add(
    "answer_dedupe",
    f"""WITH l AS (SELECT *, NULLIF(regexp_extract(x, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{8}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') AS code FROM ({_LINES})),
    m AS (SELECT *, code IS NOT NULL AND EXISTS (SELECT 1 FROM l p WHERE p.doc_id = l.doc_id AND p.code = l.code AND p.line < l.line) AS again, code IS NULL AND regexp_matches(x, '^\\s*[-*]') AS entry FROM l),
    n AS (SELECT *, last_value(CASE WHEN entry THEN NULL ELSE again END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fate FROM m)
    SELECT d.doc_id, COALESCE(string_agg(n.x, chr(10) ORDER BY n.line), '') AS deduped FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND NOT COALESCE(n.fate, false) WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
)
def answer_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return answers.dedupe_answers(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text")


_BUILT = """WITH k AS (SELECT document_id, page_start, chunk_id, 'cite-' || lpad(CAST(chunk_id % 900 + 1 AS VARCHAR), 3, '0') AS c, COALESCE(content_text, '') AS t FROM chunk WHERE document_id IS NOT NULL),
    a AS (SELECT concat_ws('/', document_id, CAST(page_start AS VARCHAR)) AS request_id, string_agg(t || ' [' || c || '].', chr(10) ORDER BY chunk_id) AS answer, list(c) FILTER (chunk_id % 7 <> 0) AS issued FROM k GROUP BY document_id, page_start),
    l AS (SELECT request_id, COALESCE(issued, []) AS issued, generate_subscripts(z, 1) AS li, regexp_replace(unnest(z), '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT *, string_split(answer, chr(10)) AS z FROM a)),
    s AS (SELECT request_id, issued, li, generate_subscripts(z, 1) AS pi, regexp_replace(unnest(z), '^\\s+|\\s+$', '', 'g') AS claim FROM (SELECT *, CASE WHEN regexp_matches(x, '^[-*•–]') THEN [x] ELSE string_split(regexp_replace(x, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS z FROM l)),
    i AS (SELECT request_id, li, pi, claim, regexp_extract_all(claim, '\\[(cite-[0-9]{3,})\\]', 1) AS ids, issued FROM s WHERE claim <> ''),
    g AS (SELECT request_id, li, pi, claim, len(ids) AS n, len(list_filter(ids, lambda z: list_contains(issued, z))) AS good, list_filter(ids, lambda z: NOT list_contains(issued, z)) AS bad FROM i),
    k2 AS (SELECT *, CASE WHEN good < n THEN trim(list_reduce(list_prepend(claim, bad), lambda t, z: replace(t, '[' || z || ']', '')), ' ') ELSE claim END AS clean FROM g),
    v AS (SELECT request_id, COALESCE(string_agg(CASE WHEN n = 0 OR good > 0 THEN NULLIF(clean, '') END, chr(10) ORDER BY li, pi), '') AS validated, CAST(sum(good) AS INTEGER) AS passed, CAST(count(*) FILTER (good < n) AS INTEGER) AS removed, CAST(count(*) FILTER (n = 0 AND length(claim) >= 10 AND NOT regexp_matches(claim, '^(==|#|คำถาม)') AND NOT claim LIKE '%?' AND NOT (starts_with(claim, 'หลักสูตร') AND length(claim) < 50)) AS INTEGER) AS unsupported, 0 AS replaced FROM k2 GROUP BY request_id)"""


def built_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of the chunks of a page, each cited; every seventh citation was never issued."""
    n = F.format_string("cite-%03d", F.pmod("chunk_id", F.lit(900)) + 1)
    rows = table(spark, d, "chunk").filter("document_id IS NOT NULL").select("document_id", "page_start", "chunk_id", n.alias("c"), F.concat(F.coalesce("content_text", F.lit("")), F.lit(" ["), n, F.lit("].")).alias("line"))
    grouped = rows.groupBy("document_id", "page_start").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "line", "c"))).alias("l"))
    return grouped.select(
        F.concat_ws("/", "document_id", F.col("page_start").cast("string")).alias("request_id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("answer"),
        F.transform(F.filter("l", lambda x: F.pmod(x["chunk_id"], F.lit(7)) != 0), lambda x: x["c"]).alias("issued"),
    )


@R.add("citations_validate", f"{_BUILT} SELECT * FROM v")
def citations_validate(spark: SparkSession, d: str) -> DataFrame:
    return answers.validate_answers(built_answers(spark, d), "request_id")


@R.add("citations_validated_texts")
def citations_validated_texts(spark: SparkSession, d: str) -> DataFrame:
    values = F.create_map(F.lit("หน่วยกิต"), F.lit("3"))
    return answers.validate_answers(built_answers(spark, d).withColumn("values", values), "request_id", "values").select("request_id", "validated", "replaced")


@R.add("unsupported_rate", f"{_BUILT} SELECT CAST(sum(unsupported) AS BIGINT) AS unsupported, CAST(sum(passed + removed + unsupported) AS BIGINT) AS claims, round(sum(unsupported) / sum(passed + removed + unsupported), 6) AS rate FROM v")
def unsupported_rate(spark: SparkSession, d: str) -> DataFrame:
    s = answers.validate_answers(built_answers(spark, d), "request_id").agg(F.sum("unsupported").alias("unsupported"), F.sum(F.col("passed") + F.col("removed") + F.col("unsupported")).alias("claims"))
    return s.select("unsupported", "claims", F.round(F.col("unsupported") / F.col("claims"), 6).alias("rate"))
