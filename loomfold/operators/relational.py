"""Relational building blocks: ranking within groups, upserts, fallbacks, differences, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.sources.shared import checkpoint


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a full order; nulls of a key form a group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group.  Spark keeps only the leading rows of a group before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")


def union_best(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Rows of both sides, one for each key, with the higher score."""
    return a.unionByName(b).groupBy(*keys).agg(F.max(score).alias(score))


def not_yet(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among those done; rows with a null key are kept."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def lookup_with_fallback(rows: DataFrame, first: DataFrame, first_keys: Sequence[str], second: DataFrame, second_keys: Sequence[str], first_value: str, second_value: str, out: str) -> DataFrame:
    """``out``: the value found by the first keys, else by the second, else null."""
    return rows.join(first, list(first_keys), "left").join(second, list(second_keys), "left").withColumn(out, F.coalesce(first_value, second_value)).drop(first_value, second_value)


def difference_both_ways(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """``(side, key)``: distinct keys found on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit(left_name).alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit(right_name).alias("side"), key))


def canonical_by(df: DataFrame, content: str, key: str, order: str) -> DataFrame:
    """``canonical_id`` (the key first in order among equal contents) and ``copies``.  Both come
    from one aggregation, so a content that a third of the rows share is combined before it moves."""
    firsts = df.groupBy(content).agg(F.min(F.struct(order, key)).alias("_f"), F.count("*").alias("copies"))
    return df.join(firsts, df[content].eqNullSafe(firsts[content])).select(df["*"], F.col(f"_f.{key}").alias("canonical_id"), "copies")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def range_violations(df: DataFrame, key: str, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """``(key, field)`` for each value out of its range; nulls are no violation."""
    checks = [
        F.when(F.lit(False) if lo is None else F.col(c) < lo, F.lit(c)).when(F.lit(False) if hi is None else F.col(c) > hi, F.lit(c))
        for c, (lo, hi) in ranges.items()
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("field"))


def running_quota(df: DataFrame, eligible: Column, order: Sequence[str], budget: int) -> DataFrame:
    """``used`` (eligible rows up to this one in the full order) and ``granted`` (eligible and within the budget).

    The order is global, yet no task holds all rows: rows are range-partitioned,
    the eligible rows of each part are counted, and every part starts from the
    sum of the parts before it.  The parts are written once, as the ranges of a
    second evaluation need not be the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(df.withColumn("_e", F.coalesce(eligible.cast("int"), F.lit(0))).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("_e").alias("_n"))
    # one row for each partition
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = F.sum("_e").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("used", F.col("_before") + F.col("_in"))
    return out.withColumn("granted", (F.col("_e") == 1) & (F.col("used") <= budget)).drop("_e", "_part", "_before", "_in")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``out``: the last value that is not null up to this row of the group."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
