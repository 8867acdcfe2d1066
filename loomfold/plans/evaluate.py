"""Queries on questions, citations, answers and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.functions import thai
from loomfold.functions.text import question_key
from loomfold.operators import answers, evaluation
from loomfold.operators.relational import cap_per_group
from loomfold.plans.registry import Registry
from loomfold.sources.tables import table

R = Registry()
PROGRAMS = ("BIT", "CGT", "HIX", "MDA", "NIS", "SEQ")


def _either(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@R.add(
    "question_classify",
    f"""WITH q AS (SELECT chunk_id, lower(trim(heading)) AS low, heading AS x, len(regexp_extract_all(regexp_replace(heading, '[0-9A-Za-z_ก-ฮะาำเแโใไๅๆ๐-๙]*[A-Za-z_ก-ฮะาำเแโใไๅๆ๐-๙][0-9A-Za-z_ก-ฮะาำเแโใไๅๆ๐-๙]*', ' ', 'g'), '[0-9]+')) AS z,
    len(list_filter(regexp_extract_all(regexp_replace(heading, '[0-9A-Za-z_ก-ฮะาำเแโใไๅๆ๐-๙]*[A-Za-z_ก-ฮะาำเแโใไๅๆ๐-๙][0-9A-Za-z_ก-ฮะาำเแโใไๅๆ๐-๙]*', ' ', 'g'), '[0-9]+'), lambda a: length(a) = 8)) AS codes FROM chunk WHERE heading IS NOT NULL AND length(heading) <= 500)
    SELECT chunk_id, CASE WHEN {_either(answers.COMPARE_WORDS)} THEN 'L4' WHEN {_either(answers.RELATION_WORDS)} THEN 'L3' WHEN codes = 1 AND {_either(answers.FIELD_WORDS)} AND NOT {_either(answers.LIST_WORDS)} THEN 'L1' WHEN {_either(answers.LIST_WORDS)} THEN 'L2' WHEN codes = 1 THEN 'L1' ELSE 'L2' END AS level FROM q""",
)
def question_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("heading IS NOT NULL AND length(heading) <= 500")
    return rows.select("chunk_id", answers.classify(F.col("heading"))["level"].alias("level"))


@R.add(
    "question_year",
    "SELECT doc_id, COALESCE(CAST(NULLIF(regexp_extract(text, 'ปี(?:ที่)?\\s*([1-4])', 1), '') AS INTEGER), CASE WHEN regexp_matches(text, 'ปี(?:ที่)?หนึ่ง') THEN 1 WHEN regexp_matches(text, 'ปี(?:ที่)?สอง') THEN 2 WHEN regexp_matches(text, 'ปี(?:ที่)?สาม') THEN 3 WHEN regexp_matches(text, 'ปี(?:ที่)?สี่') THEN 4 END) AS year FROM documents WHERE text IS NOT NULL",
)
def question_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", answers.study_year(F.col("text")).alias("year"))


@R.add(
    "version_resolve",
    """WITH v AS (SELECT DISTINCT program, curriculum_year, edition_status FROM document WHERE program IS NOT NULL), q AS (SELECT chunk_id, concat_ws(' ', heading, program, CAST(curriculum_year AS VARCHAR)) AS q FROM chunk),
    t AS (SELECT chunk_id, list_filter(regexp_extract_all(q, '[0-9]+'), lambda y: regexp_full_match(y, '25[0-9][0-9]')) AS years, regexp_extract_all(upper(q), '[A-Z][A-Z_]*') AS names FROM q),
    p AS (SELECT DISTINCT chunk_id, years, name AS program FROM (SELECT chunk_id, years, unnest(names) AS name FROM t) WHERE name IN (SELECT program FROM v)),
    a AS (SELECT p.chunk_id, v.* FROM p JOIN v ON v.program = p.program WHERE len(years) = 0 OR list_contains(years, CAST(v.curriculum_year AS VARCHAR))),
    b AS (SELECT DISTINCT t.chunk_id, v.* FROM t JOIN v ON list_contains(t.years, CAST(v.curriculum_year AS VARCHAR)) WHERE t.chunk_id NOT IN (SELECT chunk_id FROM p)) SELECT DISTINCT * FROM a UNION SELECT * FROM b""",
)
def version_resolve(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "document").select("program", "curriculum_year", "edition_status").filter("program IS NOT NULL").distinct()
    questions = table(spark, d, "chunk").select("chunk_id", F.concat_ws(" ", "heading", "program", F.col("curriculum_year").cast("string")).alias("q"))
    return answers.resolve_versions(questions, "chunk_id", "q", versions)


@R.add("citations_issued", "SELECT document_id, chunk_id, 'cite-' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS VARCHAR), 3, '0') AS citation_id FROM chunk WHERE document_id IS NOT NULL")
def citations_issued(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("document_id IS NOT NULL").select("document_id", "chunk_id", "page_start")
    return answers.issue_citations(rows, ["document_id"], [F.asc("page_start"), F.asc("chunk_id")]).select("document_id", "chunk_id", "citation_id")


@R.add(
    "answer_cache_key",
    """SELECT document_id, sha256(concat_ws(chr(31), regexp_replace(trim(regexp_replace(lower(q), '\\s+', ' ', 'g')), '[?。.]+$', ''), v, substring(sha256(t), 1, 32))) AS k FROM
    (SELECT document_id, min(COALESCE(heading, '')) AS q, string_agg(DISTINCT program || ':' || curriculum_year || ':' || edition_status, '|' ORDER BY program || ':' || curriculum_year || ':' || edition_status) AS v, string_agg(content_sha256, chr(10) ORDER BY content_sha256) AS t
    FROM chunk WHERE document_id IS NOT NULL AND program IS NOT NULL AND curriculum_year IS NOT NULL AND edition_status IS NOT NULL AND content_sha256 IS NOT NULL GROUP BY document_id)""",
)
def answer_cache_key(spark: SparkSession, d: str) -> DataFrame:
    need = "document_id IS NOT NULL AND program IS NOT NULL AND curriculum_year IS NOT NULL AND edition_status IS NOT NULL AND content_sha256 IS NOT NULL"
    rows = table(spark, d, "chunk").filter(need).groupBy("document_id").agg(
        F.min(F.coalesce("heading", F.lit(""))).alias("q"), F.collect_set(F.concat_ws(":", "program", F.col("curriculum_year").cast("string"), "edition_status")).alias("v"), F.collect_list("content_sha256").alias("t")
    )
    return rows.select("document_id", answers.cache_key(F.col("q"), F.col("v"), F.col("t")).alias("k"))


@R.add("question_keys", "SELECT chunk_id, regexp_replace(trim(regexp_replace(lower(heading), '\\s+', ' ', 'g')), '[?。.]+$', '') AS k FROM chunk WHERE heading IS NOT NULL")
def question_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").filter("heading IS NOT NULL").select("chunk_id", question_key(F.col("heading")).alias("k"))


@R.add("cer_eval")
def cer_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stage_result").filter("text IS NOT NULL").select("region_id", "stage_index", thai.composed("text").alias("t"))
    one = lambda i, n: rows.filter(F.col("stage_index") == i).groupBy("region_id").agg(F.min("t").alias(n))
    return one(1, "a").join(one(2, "b"), "region_id").select("region_id", F.round(evaluation.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@R.add(
    "cell_f1",
    """WITH a AS (SELECT DISTINCT program, code, category FROM course WHERE category IS NOT NULL), b AS (SELECT DISTINCT program, code, category FROM normalized_course WHERE category IS NOT NULL), t AS (SELECT count(*) AS tp FROM a JOIN b USING (program, code, category)),
    s AS (SELECT tp, (SELECT count(*) FROM a) AS n_found, (SELECT count(*) FROM b) AS n_reference FROM t), m AS (SELECT *, CASE WHEN n_found = 0 THEN 0 ELSE tp / n_found END AS p, CASE WHEN n_reference = 0 THEN 0 ELSE tp / n_reference END AS r FROM s)
    SELECT tp, n_found, n_reference, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM m""",
)
def cell_f1(spark: SparkSession, d: str) -> DataFrame:
    key = ["program", "code", "category"]
    need = "category IS NOT NULL AND program IS NOT NULL AND code IS NOT NULL"
    return evaluation.f1(table(spark, d, "course").filter(need), table(spark, d, "normalized_course").filter(need), key)


@R.add(
    "field_macro_f1",
    """WITH c AS (SELECT version_id, code, min(category) AS category, min(credits_raw) AS credits, max(category) AS category2, max(credits_raw) AS credits2 FROM course WHERE code IS NOT NULL GROUP BY version_id, code)
    SELECT 'category' AS field, count(*) AS n, round(avg(CASE WHEN category IS NOT DISTINCT FROM category2 THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM c UNION ALL SELECT 'credits', count(*), round(avg(CASE WHEN credits IS NOT DISTINCT FROM credits2 THEN 1.0 ELSE 0.0 END), 6) FROM c""",
)
def field_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "course").filter("code IS NOT NULL").groupBy("version_id", "code").agg(F.min("category").alias("a"), F.max("category").alias("a2"), F.min("credits_raw").alias("b"), F.max("credits_raw").alias("b2"))
    pairs = c.select(F.explode(F.array(F.struct(F.lit("category").alias("field"), F.col("a").alias("r"), F.col("a2").alias("g")), F.struct(F.lit("credits").alias("field"), F.col("b").alias("r"), F.col("b2").alias("g")))).alias("x")).select("x.*")
    return evaluation.field_accuracy(pairs, "field", "r", "g")


_RANKED = "SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY length(content_text) DESC, chunk_id) AS rank FROM chunk WHERE document_id IS NOT NULL AND content_text IS NOT NULL"


@R.add(
    "recall_at_k",
    f"""WITH r AS ({_RANKED}), g AS (SELECT document_id, chunk_id FROM chunk WHERE document_id IS NOT NULL AND contains(content_text, 'หน่วยกิต')), h AS (SELECT g.document_id, count(r.chunk_id) AS hits, count(*) AS n_gold FROM g LEFT JOIN r ON r.document_id = g.document_id AND r.chunk_id = g.chunk_id AND r.rank <= 10 GROUP BY g.document_id)
    SELECT document_id, hits, n_gold, round(hits / n_gold, 6) AS recall FROM h""",
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").filter("document_id IS NOT NULL AND content_text IS NOT NULL").select("document_id", "chunk_id", "content_text")
    ranked = cap_per_group(rows.select("document_id", "chunk_id", F.length("content_text").alias("n")), ["document_id"], [F.desc("n"), F.asc("chunk_id")], 10).withColumn("rank", F.lit(1))
    return evaluation.recall_at_k(ranked, rows.filter(F.col("content_text").contains("หน่วยกิต")), "document_id", "chunk_id", 10)


@R.add(
    "citation_metrics",
    """WITH c AS (SELECT document_id, page_start AS p FROM chunk WHERE document_id IS NOT NULL AND page_start IS NOT NULL), g AS (SELECT DISTINCT document_id, page_number AS p FROM page WHERE document_id IS NOT NULL AND length(page_text) > 300),
    a AS (SELECT c.document_id, avg(CASE WHEN g.p IS NULL THEN 0.0 ELSE 1.0 END) AS pr, count(DISTINCT g.p) AS hit FROM c LEFT JOIN g ON g.document_id = c.document_id AND g.p = c.p GROUP BY c.document_id), b AS (SELECT document_id, count(*) AS n FROM g GROUP BY 1)
    SELECT COALESCE(a.document_id, b.document_id) AS document_id, round(COALESCE(pr, 0), 6) AS "precision", round(CASE WHEN n IS NULL THEN 0 ELSE COALESCE(hit, 0) / n END, 6) AS recall FROM a FULL JOIN b ON a.document_id = b.document_id""",
)
def citation_metrics(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "chunk").filter("document_id IS NOT NULL AND page_start IS NOT NULL").select("document_id", F.col("page_start").alias("p"))
    gold = table(spark, d, "page").filter("document_id IS NOT NULL AND length(page_text) > 300").select("document_id", F.col("page_number").alias("p"))
    return evaluation.citation_pages(cited, gold, "document_id", ["p"])


@R.add(
    "version_accuracy",
    """WITH a AS (SELECT program, list_sort(list(DISTINCT curriculum_year)) AS y FROM document WHERE curriculum_year IS NOT NULL GROUP BY 1), b AS (SELECT program, list_sort(list(DISTINCT curriculum_year)) AS y FROM course WHERE curriculum_year IS NOT NULL GROUP BY 1)
    SELECT COALESCE(a.program, b.program) AS program, COALESCE(a.y = b.y, false) AS same FROM a FULL JOIN b ON a.program = b.program""",
)
def version_accuracy(spark: SparkSession, d: str) -> DataFrame:
    need = "curriculum_year IS NOT NULL"
    return evaluation.set_equality(table(spark, d, "document").filter(need), table(spark, d, "course").filter(need), "program", "curriculum_year")


@R.add(
    "scope_mismatch",
    """WITH a AS (SELECT DISTINCT document_id, page_start AS p FROM chunk), b AS (SELECT DISTINCT document_id, page_number AS p FROM page), s AS (SELECT document_id FROM a INTERSECT SELECT document_id FROM b)
    SELECT COALESCE(a.document_id, b.document_id) AS document_id, COALESCE(a.p, b.p) AS p, CASE WHEN b.p IS NULL THEN 'system' ELSE 'reference' END AS side FROM (SELECT * FROM a WHERE document_id IN (SELECT document_id FROM s)) a FULL JOIN (SELECT * FROM b WHERE document_id IN (SELECT document_id FROM s)) b ON a.document_id = b.document_id AND a.p = b.p WHERE a.p IS NULL OR b.p IS NULL""",
)
def scope_mismatch(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "chunk").select("document_id", F.col("page_start").alias("p"))
    return evaluation.scope_mismatch(a, table(spark, d, "page").select("document_id", F.col("page_number").alias("p")), ["document_id", "p"], "document_id")


@R.add(
    "metric_status",
    """WITH m AS (SELECT engine AS name, avg(quality_score) AS value, count(quality_score) AS n FROM stage_result GROUP BY engine) SELECT name, round(value, 4) AS value, n, CASE WHEN n >= 30 THEN 'measured' ELSE 'estimate' END AS status, CASE WHEN n >= 30 THEN round(value, 4) >= 0.7 END AS passed FROM m""",
)
def metric_status(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "stage_result").groupBy(F.col("engine").alias("name")).agg(F.avg("quality_score").alias("value"), F.count("quality_score").alias("n"))
    return evaluation.metric_status(m.withColumn("comparator", F.lit(">=")).withColumn("target", F.lit(0.7))).select("name", F.round("value", 4).alias("value"), "n", "status", "passed")


@R.add(
    "reproducibility",
    """WITH a AS (SELECT engine AS name, avg(confidence) AS v FROM stage_result GROUP BY engine), b AS (SELECT engine AS name, avg(confidence) AS v FROM stage_result WHERE is_selected GROUP BY engine)
    SELECT COALESCE(a.name, b.name) AS name, round(a.v, 4) IS NOT DISTINCT FROM round(b.v, 4) AS same FROM a FULL JOIN b ON a.name = b.name""",
)
def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    """A run over all readings against one over the selected ones."""
    rows = table(spark, d, "stage_result")
    run = lambda df: df.groupBy(F.col("engine").alias("name")).agg(F.avg("confidence").alias("value"))
    return evaluation.reproduced(run(rows), run(rows.filter("is_selected")), "name", "value")


@R.add("gold_coverage", "SELECT document_id FROM document d WHERE NOT EXISTS (SELECT 1 FROM chunk k WHERE k.document_id = d.document_id)")
def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document").select("document_id").join(table(spark, d, "chunk").select("document_id"), "document_id", "left_anti")
