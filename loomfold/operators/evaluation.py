"""Evaluation metrics as aggregates over pairs, with their status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def character_error_rate(read: Column, reference: Column) -> Column:
    """Edit distance over the length of the reference; 0 for an empty reference."""
    return F.when(F.length(reference) == 0, F.lit(0.0)).otherwise(F.levenshtein(read, reference) / F.length(reference))


def f1(found: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row ``tp, n_found, n_reference, precision, recall, f1`` of two sets of keys; repeated keys count once."""
    a, b = found.select(*keys).distinct(), reference.select(*keys).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), list(keys), "full_outer")
    s = both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("tp"), F.count("_a").alias("n_found"), F.count("_b").alias("n_reference"))
    p, r = ratio(F.col("tp"), F.col("n_found")), ratio(F.col("tp"), F.col("n_reference"))
    return s.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def field_accuracy(pairs: DataFrame, field: str, read: str, reference: str) -> DataFrame:
    """``(field, n, f1)``: share of equal values; precision equals recall as every pair has both."""
    return pairs.groupBy(field).agg(F.count("*").alias("n"), F.round(F.avg(F.col(read).eqNullSafe(F.col(reference)).cast("int")), 6).alias("f1"))


def recall_at_k(ranked: DataFrame, gold: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """``(query, hits, n_gold, recall)`` for every query with gold items; repeated retrieved items count once."""
    hits = ranked.filter(F.col("rank") <= k).select(query, item).distinct().join(gold.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg(F.count("*").alias("hits"))
    total = gold.groupBy(query).agg(F.count_distinct(item).alias("n_gold"))
    return total.join(hits, query, "left").select(query, F.coalesce("hits", F.lit(0)).alias("hits"), "n_gold", F.round(ratio(F.coalesce("hits", F.lit(0)), F.col("n_gold")), 6).alias("recall"))


def citation_pages(cited: DataFrame, gold: DataFrame, query: str, page: Sequence[str]) -> DataFrame:
    """``(query, precision, recall)``: precision over all citations, recall over distinct pages."""
    known = gold.select(query, *page).distinct()
    marked = cited.select(query, *page).join(known.withColumn("_k", F.lit(1)), [query, *page], "left")
    p = marked.groupBy(query).agg(F.avg(F.coalesce("_k", F.lit(0))).alias("precision"), F.count_distinct(*[F.when(F.col("_k") == 1, F.col(c)) for c in page]).alias("_hit"))
    r = known.groupBy(query).agg(F.count("*").alias("_n"))
    out = p.join(r, query, "full_outer")
    return out.select(query, F.round(F.coalesce("precision", F.lit(0.0)), 6).alias("precision"), F.round(ratio(F.coalesce("_hit", F.lit(0)), F.col("_n")), 6).alias("recall"))


def set_equality(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """``(key, same)``: whether both sides have the same set of items for a key."""
    x = a.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("_x"))
    y = b.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("_y"))
    return x.join(y, key, "full_outer").select(key, F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)).alias("same"))


def scope_mismatch(a: DataFrame, b: DataFrame, keys: Sequence[str], within: str) -> DataFrame:
    """``(keys, side)``: keys on one side only, of the values of ``within`` that both sides have."""
    shared = a.select(within).distinct().join(b.select(within).distinct(), within)
    x, y = (s.select(*keys).distinct().join(shared, within, "left_semi") for s in (a, b))
    both = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), list(keys), "full_outer")
    return both.filter("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_b").isNull(), "system").otherwise("reference").alias("side"))


def metric_status(metrics: DataFrame, least: int = 30) -> DataFrame:
    """``status`` (measured from ``least`` samples on, else estimate) and ``passed`` (null for an estimate) of ``value, n, comparator, target``."""
    v, t = F.round("value", 4), F.col("target")
    ok = F.when(F.col("comparator") == "<=", v <= t).when(F.col("comparator") == "<", v < t).otherwise(v >= t)
    measured = F.col("n") >= least
    return metrics.withColumn("status", F.when(measured, "measured").otherwise("estimate")).withColumn("passed", F.when(measured, ok))


def reproduced(old: DataFrame, new: DataFrame, name: str, value: str) -> DataFrame:
    """``(name, same)``: whether two runs agree at four decimals."""
    x = old.select(name, F.round(value, 4).alias("_o"))
    return x.join(new.select(name, F.round(value, 4).alias("_n")), name, "full_outer").select(name, F.col("_o").eqNullSafe(F.col("_n")).alias("same"))
