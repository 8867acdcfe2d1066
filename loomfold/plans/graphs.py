"""Queries on requirement graphs and on ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import graph, hierarchy, relational, state
from loomfold.plans.registry import Registry
from loomfold.sources.tables import table

R = Registry()
_CLOSURE = """e AS (SELECT DISTINCT source_path AS grp, code AS node, unnest(prerequisite_codes) AS anc FROM normalized_course), k AS (SELECT * FROM e WHERE anc IS NOT NULL),
r AS (SELECT * FROM k UNION SELECT r.grp, r.node, k.anc FROM r JOIN k ON k.grp = r.grp AND k.node = r.anc)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.links(table(spark, d, "normalized_course"), "source_path", "code", "prerequisite_codes")[0]


@R.add("direct_prerequisites", f"WITH RECURSIVE {_CLOSURE} SELECT grp, node, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY grp, node")
def direct_prerequisites(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("grp", "node").agg(F.count("*").alias("n"))


@R.add("prereq_cycles", f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT a.grp, a.node, (SELECT min(b.anc) FROM r b WHERE b.grp = a.grp AND b.node = a.node AND EXISTS (SELECT 1 FROM r c WHERE c.grp = b.grp AND c.node = b.anc AND c.anc = b.node)) AS cycle FROM r a WHERE a.node = a.anc")
def prereq_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_members(hierarchy.ancestors(_edges(spark, d)))


@R.add(
    "prereq_chain",
    f"""WITH RECURSIVE {_CLOSURE}, cyc AS (SELECT DISTINCT grp, node FROM r WHERE node = anc), bad AS (SELECT grp, node FROM cyc UNION SELECT r.grp, r.node FROM r JOIN cyc ON cyc.grp = r.grp AND cyc.node = r.anc),
    good AS (SELECT grp, node FROM (SELECT grp, node FROM k UNION SELECT grp, anc FROM k) x WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.grp = x.grp AND bad.node = x.node)),
    lv AS (SELECT grp, node, 0 AS level FROM good UNION SELECT k.grp, k.node, lv.level + 1 FROM lv JOIN k ON k.grp = lv.grp AND k.anc = lv.node JOIN good g ON g.grp = k.grp AND g.node = k.node)
    SELECT grp, node, level, CAST(row_number() OVER (PARTITION BY grp ORDER BY level, node) - 1 AS BIGINT) AS ord FROM (SELECT grp, node, CAST(max(level) AS INTEGER) AS level FROM lv GROUP BY grp, node)""",
)
def prereq_chain(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.chain_order(edges, hierarchy.ancestors(edges))


@R.add(
    "rule_checks",
    """WITH a AS (SELECT version_id, CAST(sum(credits_total) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM course WHERE version_id IS NOT NULL GROUP BY version_id)
    SELECT version_id, 'credits' AS rule, COALESCE(total >= 60, false) AS holds FROM a UNION ALL SELECT version_id, 'courses', COALESCE(n < 40, false) FROM a UNION ALL SELECT version_id, 'known', version_id IN (1, 2, 3) FROM a""",
)
def rule_checks(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "course").filter("version_id IS NOT NULL").groupBy("version_id").agg(F.sum("credits_total").alias("total"), F.count("*").alias("n"))
    long = actual.select("version_id", F.explode(F.create_map(F.lit("total"), F.col("total").cast("string"), F.lit("n"), F.col("n").cast("string"), F.lit("version"), F.col("version_id").cast("string"))).alias("attribute", "actual"))
    rules = spark.createDataFrame([("credits", "total", ">=", "60"), ("courses", "n", "<", "40"), ("known", "version", "in", "1, 2, 3")], "rule string, attribute string, cmp string, value string")
    return long.join(F.broadcast(rules), "attribute").select("version_id", "rule", graph.rule_holds(F.col("actual"), F.col("cmp"), F.col("value")).alias("holds"))


@R.add("evidence_hops")
def evidence_hops(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    seeds = edges.select(F.col("grp").alias("req"), "node").distinct()
    keyed = edges.select(F.concat_ws("|", "grp", "node").alias("node"), F.concat_ws("|", "grp", "parent").alias("parent")).distinct()
    return graph.expand_hops(seeds.groupBy("req").agg(F.concat_ws("|", "req", F.min("node")).alias("node")), keyed)


@R.add(
    "carry_forward",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""",
)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return relational.carry_forward(rows, ["user_id"], ["ts", "event_id"], "v", "carried").select("event_id", "user_id", "carried")


@R.add(
    "halter_replay",
    """WITH s AS (SELECT user_id, ts, event_id, value / 100.0 AS s, 0.05 AS c, row_number() OVER w AS n, greatest(COALESCE(max(value / 100.0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS best,
    NULLIF(sign(value / 100.0 - lag(value / 100.0) OVER w), 0) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    t AS (SELECT *, CASE WHEN d <> last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS turn FROM s),
    u AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY n) AS turns FROM t),
    v AS (SELECT *, CASE WHEN s IS NULL OR isnan(s) OR isinf(s) THEN 'nan_guard' WHEN turns >= 2 THEN 'oscillation' WHEN s - best < c THEN 'gain_below_cost' END AS why FROM u)
    SELECT user_id, CAST(COALESCE(min(n) FILTER (why IS NOT NULL), count(*)) AS BIGINT) AS steps, arg_min(why, n) FILTER (why IS NOT NULL) AS reason FROM v GROUP BY user_id""",
)
def halter_replay(spark: SparkSession, d: str) -> DataFrame:
    return state.halt_replay(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") / 100.0, F.lit(0.05))


@R.add(
    "circuit_breaker",
    """WITH s AS (SELECT event_id, user_id, ts, CASE WHEN value < 30 THEN 1 ELSE 0 END AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s),
    r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS run FROM i)
    SELECT event_id, user_id, COALESCE(max(CASE WHEN run >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS open FROM r""",
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return state.circuit_breaker(rows, ["user_id"], ["ts", "event_id"], F.coalesce(F.col("value") < 30, F.lit(False))).select("event_id", "user_id", "open")


@R.add(
    "adjudicate_best",
    """SELECT region_id, stage_result_id FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY stage_index) AS rn FROM (SELECT *, max(COALESCE(confidence, -1)) OVER (PARTITION BY region_id) AS m FROM stage_result) WHERE COALESCE(confidence, -1) >= m - 0.01 - 1e-12) WHERE rn = 1""",
)
def adjudicate_best(spark: SparkSession, d: str) -> DataFrame:
    return state.adjudicate(table(spark, d, "stage_result").select("region_id", "stage_result_id", "stage_index", "confidence"), ["region_id"], "stage_index", "confidence").select("region_id", "stage_result_id")


@R.add(
    "user_sessions",
    """SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM
    (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session""",
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = state.sessions(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 86_400)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@R.add(
    "latency_p95",
    """SELECT user_id, v[CAST(least(floor(len(v) * 0.95), len(v) - 1) AS BIGINT) + 1] AS p95 FROM (SELECT user_id, list_sort(list(value)) AS v FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100 GROUP BY user_id)""",
)
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return state.latency_p95(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "value")


@R.add("crop_cache_keys", "SELECT sha256(COALESCE(text, '')) AS h, engine, CAST(count(*) AS BIGINT) AS uses, CAST(count(*) - 1 AS BIGINT) AS hits FROM stage_result GROUP BY 1, 2")
def crop_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stage_result").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "engine").agg(F.count("*").alias("uses")).withColumn("hits", F.col("uses") - 1)
