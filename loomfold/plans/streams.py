"""Streaming queries over the events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.plans import graphs
from loomfold.plans.registry import Registry
from loomfold.sources.shared import shared_path
from loomfold.sources.tables import table
from loomfold.streaming import events

R = Registry()


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return events.file_stream(spark, d, f"{name}.parquet", table(spark, d, name).schema)


def _finish(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Runs a stream into Parquet files in the shared folder and reads them."""
    out, at = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@R.add("stream_resume", "SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """All events, and half of them a second time in their older form, as files that come in several batches."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    old = rows.filter("event_id % 2 = 0").withColumn("value", F.col("value") - 1).withColumn("ts", F.expr("ts - INTERVAL 1 SECOND"))
    files, out = shared_path(spark, "resume-files"), shared_path(spark, "resume")
    rows.unionByName(old).repartition(4).write.parquet(files)
    stream = events.file_stream(spark, files, "*.parquet", rows.schema, files=1)
    events.upsert_batches(stream, ["event_id"], "ts", out, shared_path(spark, "resume-checkpoint")).awaitTermination()
    return events.current(spark, out, ["event_id"], "ts", rows.schema).select("event_id", "user_id", "value")


@R.add(
    "stream_windows",
    """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
)
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return _finish(spark, events.windowed_counts(_stream(spark, d, "events"), "ts", "event_type"), "windows")


@R.add("stream_halting", f"SELECT user_id, CAST(steps AS INTEGER) AS steps, reason FROM ({graphs.R.sql['halter_replay']}) WHERE reason IS NOT NULL")
def stream_halting(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") / 100.0).alias("s"))
    return _finish(spark, events.halting(rows, "user_id", "at", "s", 0.05), "halting")
