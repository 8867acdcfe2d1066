"""Order-bound operators in window form: halting, circuit breaking, adjudication, sessions, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def halt_replay(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: Column, cost: Column, tau: float = 1.0, patience: int = 2, least: int = 1) -> DataFrame:
    """``(keys, steps, reason)``: where a sequence of scores stops paying, one row for each sequence.

    A step halts when a value is not finite, the direction of the score has
    turned ``patience`` times, or the gain over the best so far is below cost x
    ``tau``; not before ``least`` steps.  ``reason`` is null where no step halts.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    s = df.select(*keys, *order, score.cast("double").alias("_s"), cost.cast("double").alias("_c"))
    s = s.withColumn("_n", F.row_number().over(w)).withColumn("_best", F.greatest(F.coalesce(F.max("_s").over(before), F.lit(0.0)), F.lit(0.0)))
    s = s.withColumn("_d", F.nullif(F.signum(F.col("_s") - F.lag("_s").over(w)), F.lit(0.0)))
    s = s.withColumn("_turn", F.coalesce((F.col("_d") != F.last("_d", ignorenulls=True).over(before)).cast("int"), F.lit(0)))
    s = s.withColumn("_turns", F.sum("_turn").over(upto))
    reason = (
        F.when(~finite(F.col("_s")) | ~finite(F.col("_c")), "nan_guard").when(F.col("_n") < least, None)
        .when(F.col("_turns") >= patience, "oscillation").when(F.col("_s") - F.col("_best") < F.col("_c") * tau, "gain_below_cost")
    )
    s = s.withColumn("_why", reason)
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("_n", "_why")))
    return s.groupBy(*keys).agg(first.alias("_f"), F.count("*").alias("_all")).select(*keys, F.coalesce("_f._n", "_all").cast("long").alias("steps"), F.col("_f._why").alias("reason"))


def circuit_breaker(df: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, limit: int = 3) -> DataFrame:
    """``open``: whether a run of ``limit`` failures in a row lies before a row of its group, by gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = df.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(upto))
    s = s.withColumn("_run", F.sum("_f").over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    tripped = F.max((F.col("_run") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("open", F.coalesce(tripped, F.lit(0)) == 1).drop("_f", "_island", "_run")


def adjudicate(df: DataFrame, keys: Sequence[str], stage: str, confidence: str, band: float = 0.01) -> DataFrame:
    """The row of each group with the highest confidence; within ``band`` of it the earliest stage.  Null confidence loses to any other."""
    best = F.max(F.coalesce(confidence, F.lit(-1.0))).over(Window.partitionBy(*keys))
    near = F.coalesce(confidence, F.lit(-1.0)) >= best - band - 1e-12
    s = df.withColumn("_near", near).filter("_near")
    return s.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(stage))).filter("_r = 1").drop("_near", "_r")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap_seconds: int) -> DataFrame:
    """``session``: counts up within a group whenever more than ``gap_seconds`` lie between two rows."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def latency_p95(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, window: int = 100) -> DataFrame:
    """``(keys, p95)`` of the last ``window`` values of a group: the sorted value at 0.95 of their number."""
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= window)
    held = last.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    at = F.least(F.floor(F.size("_v") * 0.95).cast("int"), F.size("_v") - 1)
    return held.select(*keys, F.col("_v")[at].alias("p95"))
