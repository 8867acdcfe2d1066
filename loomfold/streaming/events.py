"""Structured Streaming forms: resumable ingestion, windows with late data, keyed halting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder; at most ``files`` new ones a batch, each read once over all restarts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def upsert_batches(stream: DataFrame, key: list[str], order: str, path: str, checkpoint_dir: str):
    """Starts a query that writes the latest row of each key of every batch under ``path``, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so a
    row counts once.  ``current`` merges the batches; nothing that is written is read or moved here.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        latest.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: list[str], order: str, schema: StructType) -> DataFrame:
    """The latest row of each key over all batches under ``path``; of equal ``order`` the row of the later batch counts."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("_batch", LongType())])).option("basePath", path).parquet(path)
    columns = schema.fieldNames()
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("_batch"))).alias("_r")).select("_r.*")


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, key, n, total)`` per tumbling window; rows later than ``late`` behind the newest are dropped by the watermark."""
    return (
        stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).groupBy(F.window("_at", width).alias("w"), key)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
    )


HALT_STATE = "n int, best double, last double, direction int, turns int, done boolean"


def halting(stream: DataFrame, key: str, order: str, score: str, cost: float, tau: float = 1.0, patience: int = 2) -> DataFrame:
    """``(key, steps, reason)`` as soon as the scores of a key stop paying, once for each key.

    The state of a key is six values.  Rows of a batch are taken in ``order``;
    a key whose state says done gives nothing more.
    """

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best, last, direction, turns, done = state.get if state.exists else (0, 0.0, None, 0, 0, False)
        rows = pd.concat(list(batches)).sort_values(order)
        for s in rows[score]:
            if done:
                break
            n += 1
            reason = None
            if s is None or not math.isfinite(s):
                reason = "nan_guard"
            else:
                turn = 0 if last is None or s == last else (1 if s > last else -1)
                if turn:
                    turns += direction != 0 and turn != direction
                    direction = turn
                gain, best, last = s - best, max(best, s), s
                reason = "oscillation" if turns >= patience else "gain_below_cost" if gain < cost * tau else None
            if reason:
                done = True
                yield pd.DataFrame({key: [k[0]], "steps": [n], "reason": [reason]})
        state.update((n, float(best), None if last is None else float(last), int(direction), int(turns), done))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, steps int, reason string", HALT_STATE, "append", GroupStateTimeout.NoTimeout)
