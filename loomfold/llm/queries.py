"""The queries p2, p3 and p5 to p10, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.llm import canonical_form, canonical_mapping, packing, scan_noise, spans, splitting, text_quality, tokens
from loomfold.sources.tables import table

CONTAINER = 4_096


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = text_quality.text_statistics(table(spark, d, "page"), "page_id", "page_text")
    return text_quality.beside_stored(stats, table(spark, d, "page_metrics"), "page_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_statistics(table(spark, d, "page"), "page_id", "page_text").filter("kind NOT IN ('prose', 'blank')").select("page_id", "kind")


def _items(spark: SparkSession, d: str) -> DataFrame:
    page, chunk = table(spark, d, "page"), table(spark, d, "chunk")
    return page.select(F.lit("page").alias("src"), F.col("page_id").alias("item_id"), splitting.sized(F.col("page_text")).alias("text")).unionByName(
        chunk.select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("item_id"), splitting.sized(F.col("content_text"), F.col("heading")).alias("text"))
    )


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_items(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).filter("piece = 1").select("src", "item_id")


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, scan_noise.Model, DataFrame, DataFrame]:
    page = table(spark, d, "page")
    scans = scan_noise.scan_rows(page, table(spark, d, "stage_result"))
    model, rare = scan_noise.learn(scan_noise.clean_texts(page), table(spark, d, "lexicon_term"), scans)
    return scans, model, rare, scan_noise.with_document(scans, page)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.noise(*_scans(spark, d))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(*_scans(spark, d))


def _looks(spark: SparkSession, d: str) -> DataFrame:
    course, page = table(spark, d, "course"), table(spark, d, "page")
    return course.select(F.lit("course").alias("src"), F.col("course_id").alias("id"), F.col("name_th").alias("text")).unionByName(
        page.select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("page_text").alias("text"))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_form.same_look(_looks(spark, d))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    return canonical_form.canonical_text(_looks(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_mapping.map_to_canonical(table(spark, d, "bit_academic_plan_coop"), "row_id", ["category", "type"], table(spark, d, "canonical_value"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return tokens.encode(docs, lexicon=tokens.compile_lexicon(docs))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sizes = tokens.token_counts(docs, lexicon=tokens.compile_lexicon(docs))
    return packing.pack(sizes, "doc_id", "n_tokens", CONTAINER)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amount(table(spark, d, "documents"))


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_links(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_statistics": p2_statistics, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p5_texts": p5_texts, "p6_found": p6_found, "p6_texts": p6_texts, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_shared": p10_shared, "p10_links": p10_links}


P3_SQL = """
SELECT 'page' AS src, page_id AS item_id FROM page WHERE length(page_text) > 1200
UNION ALL
SELECT 'chunk', chunk_id FROM chunk
WHERE coalesce(length(content_text), 0) + CASE WHEN coalesce(heading, '') = '' THEN 0 ELSE length(heading) + 1 END > 1200
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL}
