"""Filling containers of fixed capacity with items that are not split.

The plan is made on the histogram of lengths, not on the items: best fit in
decreasing order, for all items of a length at once.  Containers that are
equally full form one range, so the plan has a few rows for each length and is
the same for a thousand items or a billion.  An item then finds its slot by its
rank among the items of its length.  Ranks are counted in parts and shifted by
the parts before, so a length that holds a third of all items is no one task's.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.sources.shared import checkpoint

#: Items of one length that are ranked together; a length with more is ranked in parts.
PART = 500_000
PLAN = "size int, first long, n long, per long, container long, offset int"


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots for ``histogram`` (length -> number of items), and the number of containers.

    A row ``(size, first, n, per, container, offset)`` gives the items ``first`` to
    ``first + n - 1`` of that size, ``per`` in each container from ``container`` on,
    the place ``offset`` on.  Each item goes to the fullest container that holds it.
    Its work and memory follow the number of lengths, at most ``capacity``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (container, how many)
    left: list[int] = []
    made = 0

    def put_back(space: int, start: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in room:
                insort(left, space)
                room[space] = []
            room[space].append((start, n))

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        todo, first = histogram[size], 0
        while todo:
            i = bisect_left(left, size)
            if i < len(left):
                space = left[i]
                start, n = room[space].pop()
                if not room[space]:
                    del room[space], left[i]
            else:
                space, start, n = capacity, made, -(-todo // (capacity // size))
                made += n
            per = min(space // size, todo)
            full = min(n, todo // per)
            rows.append((size, first, full * per, per, start, capacity - space))
            put_back(space - per * size, start, full)
            todo, first, start, n = todo - full * per, first + full * per, start + full, n - full
            if todo and n:  # the last container of the range takes the few that are left
                rows.append((size, first, todo, todo, start, capacity - space))
                put_back(space - todo * size, start, 1)
                first, start, n, todo = first + todo, start + 1, n - 1, 0
            put_back(space, start, n)
    return rows, made


def _ranked(items: DataFrame, by: str, order: list[str], histogram: dict[int, int], part: int) -> DataFrame:
    """``rank`` from 0 within ``by``, whose values and counts are ``histogram``.  A value with more than ``part`` items is
    counted in as many parts as that takes, so no task sorts a whole hot length."""
    parts = items.sparkSession.createDataFrame([(v, -(-n // part)) for v, n in histogram.items()], "_by int, _parts int")
    # a row for each length, whatever the number of items
    parted = items.join(F.broadcast(parts), F.col(by) == F.col("_by")).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_by", "_parts")
    sums = parted.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = parted.withColumn("_in", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1)
    return inside.join(before.select(by, "_part", "_before"), [by, "_part"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def pack(items: DataFrame, key: str, size: str, capacity: int, part: int = PART) -> DataFrame:
    """``(key, piece, size, container, offset)``: where each item lies.

    Only an item longer than ``capacity`` is split, into pieces that fill a
    container and a rest; ``piece`` counts from 0.  An item of length 0 or null
    needs no room: its ``container`` and ``offset`` are null, its size 0.  Ties
    are settled by the key, repeated keys each get a place of their own, an empty
    table gives no rows.  The driver sees the histogram, at most ``capacity`` rows.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    whole = checkpoint(items.select(F.col(key).alias("_key"), n.alias("_len")))
    last = F.greatest(F.ceil(F.col("_len") / capacity) - 1, F.lit(0)).cast("int")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "_key", "piece", F.least(F.lit(capacity), F.col("_len") - F.col("piece").cast("long") * capacity).cast("int").alias("size")
    )
    histogram = {r["size"]: r["n"] for r in pieces.filter("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan_containers(histogram, capacity)
    plan = items.sparkSession.createDataFrame(rows, PLAN)
    ranked = _ranked(pieces.filter("size > 0"), "size", ["_key", "piece"], histogram, part)
    placed = ranked.join(
        # a few rows for each length up to the capacity, whatever the number of items
        F.broadcast(plan.select(F.col("size").alias("_size"), "first", "n", "per", F.col("container").alias("_from"), F.col("offset").alias("_at"))),
        (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")),
    )
    turn = F.col("rank") - F.col("first")
    out = placed.select(
        F.col("_key").alias(key), "piece", "size", (F.col("_from") + F.floor(turn / F.col("per"))).alias("container"),
        (F.col("_at") + (turn % F.col("per")) * F.col("size")).cast("int").alias("offset"),
    )
    empty = whole.filter("_len = 0").select(F.col("_key").alias(key), F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("offset"))
    return out.unionByName(empty)
