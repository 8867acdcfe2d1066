"""Requirement graphs: cycles, chains in order, rule checks, hop-wise expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfold.operators.hierarchy import ancestors
from loomfold.sources.shared import checkpoint


def cycle_nodes(pairs: DataFrame) -> DataFrame:
    """``(grp, node, hops)``: nodes on a cycle and the length of the shortest one through them."""
    return pairs.filter("node = anc").select("grp", "node", "hops")


def cycle_members(pairs: DataFrame) -> DataFrame:
    """``(grp, node, cycle)``: the first node, by name, of all that a node reaches and is reached from."""
    back = pairs.select("grp", F.col("node").alias("anc"), F.col("anc").alias("node"))
    return pairs.join(back, ["grp", "node", "anc"]).groupBy("grp", "node").agg(F.min("anc").alias("cycle"))


def cycle_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(grp, node, path)``: for the first node of each cycle a shortest way from it back to it, as an array that begins and
    ends with it; of equal ways the one with the first names.  A round adds a node to all ways, and there are as
    many as the longest of these shortest cycles has links."""
    pairs = checkpoint(pairs)
    first = cycle_members(pairs).filter("node = cycle").select("grp", "node")
    left = pairs.select("grp", F.col("node").alias("at"), F.col("anc").alias("node"), "hops")
    open_ = checkpoint(first.join(cycle_nodes(pairs), ["grp", "node"]).select("grp", "node", F.col("node").alias("at"), "hops", F.array("node").alias("path")))
    done = open_.limit(0).select("grp", "node", "path")
    step = edges.select("grp", F.col("node").alias("at"), F.col("parent").alias("to"))
    while not open_.isEmpty():
        ahead = open_.join(step, ["grp", "at"]).select("grp", "node", F.col("to").alias("at"), (F.col("hops") - 1).alias("hops"), F.concat("path", F.array("to")).alias("path"))
        home = ahead.filter("hops = 0 AND at = node")
        on = ahead.filter("hops > 0").join(left.withColumnRenamed("hops", "need"), ["grp", "at", "node"]).filter("need = hops").drop("need")
        best = home.unionByName(on).groupBy("grp", "node").agg(F.min_by(F.struct("at", "hops", "path"), F.col("at")).alias("b")).select("grp", "node", "b.*")
        best = checkpoint(best)
        done = done.unionByName(best.filter("hops = 0").select("grp", "node", "path"))
        open_ = best.filter("hops > 0")
    return done


def chain_order(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(grp, node, level, ord)``: every node after all it requires; nodes on or behind a cycle do not come out.

    ``level`` is the length of the longest chain below a node, by the same
    contraction as the closure, with the longest ways; ``ord`` counts within the
    group by level and name.
    """
    nodes = edges.select("grp", "node").union(edges.select("grp", F.col("parent").alias("node"))).distinct()
    on_cycle = cycle_nodes(pairs).select("grp", F.col("node").alias("anc"))
    doomed = checkpoint(pairs.join(on_cycle, ["grp", "anc"], "left_semi").select("grp", "node").distinct())
    far = ancestors(edges.join(doomed, ["grp", "node"], "left_anti"), longest=True).groupBy("grp", "node").agg(F.max("hops").alias("level"))
    clean = nodes.join(doomed, ["grp", "node"], "left_anti")
    levels = clean.join(far, ["grp", "node"], "left").select("grp", "node", F.coalesce("level", F.lit(0)).alias("level"))
    return levels.withColumn("ord", F.row_number().over(Window.partitionBy("grp").orderBy("level", "node")) - 1)


def rule_holds(actual: Column, comparator: Column, value: Column) -> Column:
    """Whether a value meets a rule; null or non-numeric values do not.  ``in`` takes a list separated by commas."""
    a, v = actual.try_cast("double"), value.try_cast("double")
    number = (
        F.when(comparator == ">=", a >= v).when(comparator == ">", a > v).when(comparator == "<=", a <= v).when(comparator == "<", a < v).when(comparator == "=", F.coalesce(a == v, actual == value))
    )
    member = F.array_contains(F.transform(F.split(value, ","), lambda x: F.trim(x)), F.trim(actual))
    return F.coalesce(F.when(comparator == "in", member).otherwise(number), F.lit(False))


def expand_hops(seeds: DataFrame, edges: DataFrame, hops: int = 3, per_hop: int = 10, most: int = 60) -> DataFrame:
    """``(req, node, hop)``: for each request what its seeds reach in at most ``hops`` steps, at most ``per_hop`` new nodes
    a step (by name) and ``most`` in all.  The caps are the feature: an evidence graph is bounded by its request."""
    seen = checkpoint(seeds.select("req", "node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for h in range(1, hops + 1):
        new = front.join(edges, "node").select("req", F.col("parent").alias("node")).distinct().join(seen, ["req", "node"], "left_anti")
        capped = new.withColumn("_r", F.row_number().over(Window.partitionBy("req").orderBy("node"))).filter(F.col("_r") <= per_hop)
        front = checkpoint(capped.select("req", "node", F.lit(h).alias("hop")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    ranked = seen.withColumn("_r", F.row_number().over(Window.partitionBy("req").orderBy("hop", "node")))
    return ranked.filter(F.col("_r") <= most).drop("_r")
