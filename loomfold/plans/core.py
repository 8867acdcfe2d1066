"""All queries outside the text subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import hierarchy, packed_values
from loomfold.plans import catalog, evaluate, graphs, ingest, questions, retrieval, store, streams, texts
from loomfold.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.explode_packed(table(spark, d, "bit_academic_plan_coop"), "row_id", ["code", "credits", "prerequisite"])


def _course_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return hierarchy.links(table(spark, d, "normalized_course"), "source_path", "code", "prerequisite_codes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges, _ = _course_links(spark, d)
    return hierarchy.ancestors(edges).select(F.col("grp").alias("source_path"), F.col("node").alias("code"), F.col("anc").alias("required"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _course_links(spark, d)
    found = hierarchy.hierarchy(edges, nodes, hierarchy.ancestors(edges))
    return hierarchy.paths(found).withColumnsRenamed({"grp": "source_path", "node": "code"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        found |= m.R.queries
    return found | {"p1_found": p1_found, "p4_found": p4_found, "p4_hierarchy": p4_hierarchy}


MODULES = (catalog, retrieval, texts, ingest, graphs, evaluate, questions, store, streams)

P4_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT source_path, code, unnest(prerequisite_codes) AS required FROM normalized_course WHERE code IS NOT NULL AND source_path IS NOT NULL),
k AS (SELECT * FROM e WHERE required IS NOT NULL),
r AS (SELECT * FROM k UNION SELECT r.source_path, r.code, k.required FROM r JOIN k ON k.source_path = r.source_path AND k.code = r.required)
SELECT source_path, code, required FROM r
"""


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= m.R.sql
    return found | {"p4_found": P4_SQL}
