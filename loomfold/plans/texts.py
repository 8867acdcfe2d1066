"""Queries on texts, parsers, page quality, chunks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.functions import parsers, text, thai
from loomfold.operators import pages, relational
from loomfold.plans.registry import Registry
from loomfold.sources.tables import table

R = Registry()
#: Characters of a readable page.
DECLARED = r"\u0E00-\u0E7FA-Za-z0-9.,;:!?()\[\]{}<>/\\\-–—_'\"“”‘’%&*+=@#$^~|`"


def _terms(spark: SparkSession, d: str) -> list[str]:
    return [r["term"] for r in table(spark, d, "lexicon_term").orderBy("term_id").collect()]  # a fixed list


@R.add(
    "page_quality_score",
    """WITH s AS (SELECT page_id, page_text AS x, regexp_replace(page_text, '\\s', '', 'g') AS solid FROM page WHERE page_text IS NOT NULL), m AS (SELECT page_id, COALESCE(max(image_area_ratio), 0.0) AS i FROM page_metrics GROUP BY page_id),
    n AS (SELECT s.page_id, length(x) AS chars, length(solid) AS ns, length(regexp_replace(solid, '[\\x{0E00}-\\x{0E7F}A-Za-z0-9.,;:!?()\\[\\]{}<>/\\\\\\-–—_''"“”‘’%&*+=@#$^~|`]', '', 'g')) AS bad, COALESCE(m.i, 0.0) AS i, (SELECT CAST(sum((length(s.x) - length(replace(s.x, l.term, ''))) // length(l.term)) AS BIGINT) FROM lexicon_term l) AS terms FROM s LEFT JOIN m ON m.page_id = s.page_id)
    SELECT page_id, terms, round(greatest(0.0, least(1.0, 0.45 * least(chars / 1200.0, 1.0) + 0.20 * (1 - CASE WHEN ns = 0 THEN 0.0 ELSE bad / ns END) + 0.20 * (1 - i) + 0.15 * least(terms / 12.0, 1.0))), 6) AS score FROM n""",
)
def page_quality_score(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("page_text")
    images = table(spark, d, "page_metrics").groupBy("page_id").agg(F.max("image_area_ratio").alias("i"))
    rows = table(spark, d, "page").filter("page_text IS NOT NULL").select("page_id", F.length(c).alias("n"), text.out_of_charset(c, DECLARED).alias("o"), text.term_count(c, _terms(spark, d)).cast("long").alias("terms"))
    i = F.coalesce("i", F.lit(0.0))
    return rows.join(images, "page_id", "left").select("page_id", "terms", F.round(pages.page_score(F.col("n"), F.col("o"), i, F.col("terms")), 6).alias("score"))


@R.add(
    "page_route",
    """SELECT p.page_id, CASE WHEN length(p.page_text) = 0 THEN 'deep' WHEN COALESCE(m.i, 0) >= 0.6 THEN 'deep' WHEN COALESCE(m.i, 0) <= 0.3 THEN 'fast' ELSE 'standard' END AS route
    FROM page p LEFT JOIN (SELECT page_id, max(image_area_ratio) AS i FROM page_metrics GROUP BY page_id) m ON m.page_id = p.page_id WHERE p.page_text IS NOT NULL""",
)
def page_route(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "page_metrics").groupBy("page_id").agg(F.max("image_area_ratio").alias("i"))
    return table(spark, d, "page").filter("page_text IS NOT NULL").join(images, "page_id", "left").select("page_id", pages.page_route(F.length("page_text"), F.col("i")).alias("route"))


@R.add(
    "quota_gate",
    """WITH e AS (SELECT page_id, length(page_text) < 120 AS low FROM page WHERE page_text IS NOT NULL), r AS (SELECT *, CAST(sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (ORDER BY page_id) AS BIGINT) AS used FROM e)
    SELECT page_id, used, low AND used <= 979 AS granted FROM r""",
)
def quota_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page").filter("page_text IS NOT NULL").select("page_id", (F.length("page_text") < 120).alias("low"))
    return relational.running_quota(rows, F.col("low"), ["page_id"], 979).select("page_id", "used", "granted")


@R.add(
    "text_keys",
    """SELECT course_id, lower(regexp_replace(regexp_replace(name_th, '[\\x{0E31}\\x{0E34}-\\x{0E3A}\\x{0E47}-\\x{0E4E}]', '', 'g'), '\\s', '', 'g')) AS match_key, lower(regexp_replace(name_en, '\\s', '', 'g')) AS name_key,
    trim(regexp_replace(name_en, '\\s+', ' ', 'g')) AS squeezed, regexp_replace(name_th, '[\\x{0E48}-\\x{0E4C}]', '', 'g') AS toneless FROM course WHERE name_th IS NOT NULL AND name_en IS NOT NULL""",
)
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    th, en = F.col("name_th"), F.col("name_en")
    return table(spark, d, "course").filter("name_th IS NOT NULL AND name_en IS NOT NULL").select(
        "course_id", text.match_key(th).alias("match_key"), text.name_key(en).alias("name_key"), text.squeeze(en).alias("squeezed"), text.without(th, text.TONES).alias("toneless")
    )


@R.add(
    "code_extraction",
    "SELECT doc_id, code, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS code FROM documents) WHERE regexp_full_match(code, '\\p{Nd}{8}') GROUP BY doc_id, code",
)
def code_extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({text.CODE})"), F.lit(1))).alias("code"))
    return rows.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@R.add("chunk_pages")
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.chunk_pages(table(spark, d, "page"))


@R.add("table_cells")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return pages.table_cells(table(spark, d, "page"))


@R.add("table_shape_violations")
def table_shape_violations(spark: SparkSession, d: str) -> DataFrame:
    return pages.shape_violations(pages.table_cells(table(spark, d, "page")))


_CONTEXT = """SELECT page_id, CASE WHEN len(y) = 1 THEN CAST(y[1] AS INTEGER) END AS year, CASE WHEN len(s) = 1 THEN CAST(s[1] AS INTEGER) END AS semester FROM (SELECT page_id,
list_distinct(regexp_extract_all(page_text || ' ', '(?:ชั้นปีที่|ปีที่|ปีการศึกษาที่|[Yy]ear)\\s*([1-8])(?:\\D)', 1)) AS y, list_distinct(regexp_extract_all(page_text || ' ', '(?:ภาคการศึกษาที่|ภาคเรียนที่|ภาคที่|[Ss]emester)\\s*([1-3])(?:\\D)', 1)) AS s FROM page WHERE page_text IS NOT NULL)"""


@R.add("plan_context", _CONTEXT)
def plan_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page").filter("page_text IS NOT NULL").select("page_id", pages.plan_context(F.col("page_text")).alias("c")).select("page_id", "c.year", "c.semester")


@R.add(
    "metadata_resolution",
    """SELECT document_id, COALESCE(NULLIF(json_extract_string(metadata_source_json, '$.program'), ''), 'none') AS program_from, COALESCE(NULLIF(json_extract_string(metadata_source_json, '$.edition'), ''), 'none') AS edition_from,
    COALESCE(program, upper(split_part(relative_path, '/', 2))) AS program, program IS DISTINCT FROM upper(split_part(relative_path, '/', 2)) AS conflict FROM document""",
)
def metadata_resolution(spark: SparkSession, d: str) -> DataFrame:
    source = F.from_json("metadata_source_json", "program string, edition string")
    hint = F.upper(F.split_part("relative_path", F.lit("/"), F.lit(2)))
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))
    return table(spark, d, "document").select(
        "document_id", none(source["program"]).alias("program_from"), none(source["edition"]).alias("edition_from"),
        F.coalesce("program", hint).alias("program"), (~F.col("program").eqNullSafe(hint)).alias("conflict"),
    )


@R.add(
    "credits_parse",
    """WITH c AS (SELECT course_id, credits_raw AS r, regexp_matches(credits_raw, '^\\d+\\(\\d+-\\d+-\\d+\\)$') AS fits FROM course WHERE credits_raw IS NOT NULL),
    v AS (SELECT *, CASE WHEN fits THEN CAST(regexp_extract(r, '^(\\d+)', 1) AS BIGINT) END AS a, CASE WHEN fits THEN CAST(regexp_extract(r, '\\((\\d+)', 1) AS BIGINT) END AS b, CASE WHEN fits THEN CAST(regexp_extract(r, '\\(\\d+-(\\d+)', 1) AS BIGINT) END AS c, CASE WHEN fits THEN CAST(regexp_extract(r, '(\\d+)\\)$', 1) AS BIGINT) END AS e FROM c)
    SELECT course_id, fits AND a <= 30 AND b <= 30 AND c <= 30 AND e <= 30 AS ok, CAST(CASE WHEN fits AND greatest(a, b, c, e) <= 30 THEN a END AS INTEGER) AS total, CAST(CASE WHEN fits AND greatest(a, b, c, e) <= 30 THEN e END AS INTEGER) AS self_study FROM v""",
)
def credits_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "course").filter("credits_raw IS NOT NULL").select("course_id", parsers.credits(F.col("credits_raw")).alias("c"))
    return rows.select("course_id", "c.ok", "c.total", "c.self_study")


@R.add("prerequisite_parse")
def prerequisite_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bit_academic_plan_coop").select("row_id", parsers.prerequisite(F.col("prerequisite")).alias("p"))
    return rows.select("row_id", "p.*")


@R.add("ground_truth_rows", "SELECT row_id, trim(replace(code, chr(10), ' ')) AS code, COALESCE(TRY_CAST(CASE WHEN regexp_full_match(year, '\\d{1,9}') THEN year END AS INTEGER), 0) AS year, COALESCE(TRY_CAST(CASE WHEN regexp_full_match(semester, '\\d{1,9}') THEN semester END AS INTEGER), 0) AS semester FROM bit_academic_plan_coop WHERE code IS NOT NULL AND NOT starts_with(code, 'หมายเหตุ')")
def ground_truth_rows(spark: SparkSession, d: str) -> DataFrame:
    number = lambda c: F.coalesce(F.when(F.col(c).rlike(r"^\d{1,9}$"), F.col(c).try_cast("int")), F.lit(0))
    rows = table(spark, d, "bit_academic_plan_coop").filter("code IS NOT NULL AND NOT startswith(code, 'หมายเหตุ')")
    return rows.select("row_id", F.trim(F.replace("code", F.lit("\n"), F.lit(" "))).alias("code"), number("year").alias("year"), number("semester").alias("semester"))


@R.add("hash_parts", "SELECT doc_id, sha256(concat_ws(chr(31), source, COALESCE(text, ''))) AS h, substring(sha256(COALESCE(text, '')), 1, 16) AS short FROM documents WHERE source IS NOT NULL")
def hash_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", text.hash_parts(F.col("source"), t).alias("h"), F.substring(F.sha2(t, 256), 1, 16).alias("short"))


@R.add("replacement_quality", "SELECT page_id, round(1 - (length(page_text) - length(replace(page_text, chr(65533), ''))) / length(page_text), 6) AS q FROM page WHERE length(page_text) > 0")
def replacement_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page").filter("length(page_text) > 0").select("page_id", F.round(1 - text.occurrences(F.col("page_text"), "�") / F.length("page_text"), 6).alias("q"))


@R.add(
    "heading_segments",
    f"""SELECT chunk_id, CAST(sum(CASE WHEN regexp_matches(trim(x, ' '), '^(?:{pages.HEADING.pattern})') THEN 1 ELSE 0 END) AS BIGINT) AS n_headings, count(*) AS n_lines FROM (SELECT chunk_id, unnest(string_split(content_text, chr(10))) AS x FROM chunk) GROUP BY chunk_id""",
)
def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "chunk").select("chunk_id", F.posexplode(F.split("content_text", "\n")).alias("line", "text"))
    return pages.header_segments(lines, ["chunk_id"], "line", "text").groupBy("chunk_id").agg(F.max("segment").alias("n_headings"), F.count("*").alias("n_lines"))


@R.add("assembled_lines")
def assembled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Glyphs laid out from the whole names of the courses: twenty courses are a page, so no page grows with the table."""
    rows = table(spark, d, "course").filter("name_th IS NOT NULL").select(F.expr("course_id div 20").alias("page_id"), (F.col("course_id") % 20).alias("at"), F.posexplode(F.split("name_th", "")).alias("i", "codepoint"))
    zero = F.col("codepoint").rlike("[ัิ-ฺ็-๎]")
    glyphs = rows.filter("codepoint <> ''").select(
        "page_id", "codepoint", (F.col("i") * 8.0).alias("x0"), (F.col("i") * 8.0 + F.when(zero, 0.0).otherwise(8.0)).alias("x1"), (F.col("at") * 20.0).alias("baseline"),
        F.lit(16.0).alias("font_size"), (F.col("at") * 100000 + F.col("i")).cast("int").alias("ord"),
    )
    return pages.assemble_lines(glyphs)


@R.add("composed_names", "SELECT course_id, nfc_normalize(name_th) AS name FROM course WHERE name_th IS NOT NULL")
def composed_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "course").filter("name_th IS NOT NULL").select("course_id", thai.composed("name_th").alias("name"))


@R.add("thai_normal_text")
def thai_normal_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page").filter("page_text IS NOT NULL").select("page_id", thai.normal_text(F.col("page_text")).alias("text"))
    return rows.select("page_id", "text", thai.violations(F.col("text")).alias("violations"))


@R.add("font_mark_counts", "SELECT course_id, upper(lpad(to_hex(unicode(c)), 4, '0')) AS code_point, CAST(count(*) AS BIGINT) AS n FROM (SELECT course_id, unnest(regexp_extract_all(name_th, '[\\x{F700}\\x{F704}\\x{F707}\\x{F708}\\x{F70D}\\x{F70F}\\x{F711}\\x{F714}-\\x{F71A}]')) AS c FROM course) GROUP BY 1, 2")
def font_mark_counts(spark: SparkSession, d: str) -> DataFrame:
    return thai.unmapped_font_marks(table(spark, d, "course"), "course_id", "name_th")


@R.add("sign_counts", "SELECT course_id, sign, CAST(count(*) AS BIGINT) AS n FROM (SELECT course_id, unnest(regexp_extract_all(regexp_replace(name_en, '\\s', '', 'g'), '[\\x{00}-\\x{10FFFF}]')) AS sign FROM course WHERE name_en IS NOT NULL) GROUP BY 1, 2")
def sign_counts(spark: SparkSession, d: str) -> DataFrame:
    return thai.sign_counts(table(spark, d, "course").filter("name_en IS NOT NULL"), "course_id", "name_en")
