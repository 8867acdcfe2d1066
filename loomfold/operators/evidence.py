"""Evidence graphs of requests: which nodes and edges are taken, and traces of requests."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Nodes a request may hold, in all and at one hop.
MOST_NODES, MOST_PER_HOP = 60, 10


def admit_nodes(nodes: DataFrame, request: str, node: str, hop: str, order: Sequence[str], provenance: Sequence[str], allowed: Column, most: int = MOST_NODES, per_hop: int = MOST_PER_HOP) -> DataFrame:
    """``(request, node, hop, verdict)`` of every offered node: ``missing_provenance``, ``other_version``, ``duplicate`` (offered
    before), ``hop_full``, ``full`` or ``taken``.  The first reason counts; nodes are offered by hop, then in ``order``.
    The limits are the feature: a graph is bounded by its request.  ``provenance`` are columns that must not be null."""
    w = Window.partitionBy(request).orderBy(hop, *order)
    whole = F.lit(True)
    for c in provenance:
        whole = whole & F.col(c).isNotNull()
    why = F.when(~whole, "missing_provenance").when(~F.coalesce(allowed, F.lit(False)), "other_version")
    marked = nodes.withColumn("_why", why)
    again = F.row_number().over(Window.partitionBy(request, node, F.col("_why").isNull()).orderBy(hop, *order)) > 1
    marked = marked.withColumn("_why", F.coalesce("_why", F.when(again, "duplicate")))
    nth = F.count(F.when(F.col("_why").isNull(), 1)).over(Window.partitionBy(request, hop).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_why", F.coalesce("_why", F.when(nth > per_hop, "hop_full")))
    total = F.count(F.when(F.col("_why").isNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("verdict", F.coalesce("_why", F.when(total > most, "full"), F.lit("taken"))).select(request, node, hop, "verdict")


def acyclic_edges(edges: DataFrame, request: str, source: str, target: str, order: str) -> DataFrame:
    """``(request, source, target, order, taken)``: edges in their order, without those that would close a circle.

    What an edge closes depends on all edges taken before it, so a request is one
    pass; it holds no more edges than pairs of the nodes a request may have."""
    kinds = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        taken = []
        pdf = pdf.sort_values(order)
        for a, b in zip(pdf[source], pdf[target], strict=True):
            seen, front = set(), [b]
            while front:
                x = front.pop()
                if x not in seen:
                    seen.add(x)
                    front += out.get(x, ())
            taken.append(a not in seen)
            if taken[-1]:
                out.setdefault(a, []).append(b)
        return pdf[[request, source, target, order]].assign(taken=taken)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (request, source, target, order)) + ", taken boolean"
    return edges.select(request, source, target, order).groupBy(request).applyInPandas(run, schema)


def trace_violations(traces: DataFrame, key: str, needed: Sequence[str]) -> DataFrame:
    """``(key, problem)``: traces without a needed value, with an id that comes twice, or with scans on the path of a question."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in needed]))
    single = traces.select(key, F.explode(F.concat(missing, F.when(F.col("ocr_invocations") != 0, F.array(F.lit("scan"))).otherwise(F.array().cast("array<string>")))).alias("problem"))
    twice = traces.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("repeated").alias("problem"))
    return single.unionByName(twice)


def cascade(stages: DataFrame, region: str, order: str, confidence: str, elapsed: str, enough: float, budget: float) -> DataFrame:
    """``(region, order, run, chosen)`` of the stages of a region: a stage runs if no stage before it was sure ``enough`` and the
    time before it is under the ``budget``; of those that ran the surest is chosen, the first of equals."""
    before = Window.partitionBy(region).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.max(F.coalesce(F.col(confidence) >= enough, F.lit(False))).over(before), F.lit(False))
    used = F.coalesce(F.sum(elapsed).over(before), F.lit(0))
    ran = stages.withColumn("run", ~sure & (used < budget))
    best = F.row_number().over(Window.partitionBy(region).orderBy(F.desc("run"), F.desc(F.coalesce(F.col(confidence), F.lit(-1.0))), F.asc(order)))
    return ran.withColumn("chosen", F.col("run") & (best == 1)).select(region, order, "run", "chosen")
