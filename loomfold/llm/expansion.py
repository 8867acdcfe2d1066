"""Pairs of classes carried over to their members, with hot classes in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a class that meet in one task's key; a larger class is met in so many parts as it needs.
PART = 1_000


def _parted(members: DataFrame, part: int) -> DataFrame:
    """``(cls, id, part)`` with ``parts``, the number of parts of the class."""
    size = members.groupBy("cls").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    return members.join(size, "cls").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def expanded(pairs: DataFrame, members: DataFrame, part: int = PART) -> DataFrame:
    """``(a, b, id_a, id_b)`` for the distinct class pairs ``(a, b)`` and the members ``(cls, id)``.

    Each member of ``a`` meets each of ``b``; a class of any size is spread
    over its parts on either side, so no key holds more than about ``part`` members."""
    held = _parted(members, part)
    size = held.groupBy("cls").agg(F.max("parts").alias("parts"))
    ways = pairs.join(size.withColumnsRenamed({"cls": "a", "parts": "n_a"}), "a").join(size.withColumnsRenamed({"cls": "b", "parts": "n_b"}), "b")
    ways = ways.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    left = held.select(F.col("cls").alias("a"), F.col("part").alias("part_a"), F.col("id").alias("id_a"))
    right = held.select(F.col("cls").alias("b"), F.col("part").alias("part_b"), F.col("id").alias("id_b"))
    return ways.select("a", "b", "part_a", "part_b").join(left, ["a", "part_a"]).join(right, ["b", "part_b"]).select("a", "b", "id_a", "id_b")
