"""Parent–child rows to full hierarchies: all ancestors, depth, path, roots, cycles.

Links are grouped into fragments of bounded size that follow the chains of
parents: some nodes, chosen by hash, are *heads*, and every other node goes up
its chain to the next head, whose fragment it joins.  A group with few links is
one fragment.  A task contracts the chains of a fragment to what each node
reaches there, and to its *exits*: nodes whose links go on in another fragment.
Only exits that other nodes run into, with the exits they lead to themselves,
form the quotient graph.  It is solved in the same way, and the fragments'
answers are expanded by its answer.

A chain loses all nodes but its heads at each level, a broad tree all its
leaves, so the levels grow with the logarithm of the links.  Links that are
woven so densely that a level does not halve them are followed step by step
instead; such graphs have short ways.  No task holds more than ``fragment``
links, however large a group is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfold.sources.shared import stored

#: Links a task solves at once: at most FRAGMENT ** 2 / 2 pairs come from one fragment.
FRAGMENT = 256
#: One node in so many is a head, and the way up to a head is followed for 2 ** CLIMB links.
HEADS, CLIMB = 12, 5
#: Rows given to the JVM at once.
_BATCH = 100_000
_PAIRS = "grp string, frag long, node string, anc string, hops int"


def links(df: DataFrame, group: str, node: str, parents: str) -> tuple[DataFrame, DataFrame]:
    """``(grp, node, parent)`` links and ``(grp, node)`` nodes, both distinct.

    ``parents`` is an array column.  Null groups and null nodes give nothing;
    null arrays, and nulls inside arrays, count for nothing; rows of one node
    add up; a parent without a row of its own is a node.
    """
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(node).cast("string").alias("node"), F.col(parents).cast("array<string>").alias("ps")).filter(
        F.col("grp").isNotNull() & F.col("node").isNotNull()
    )
    edges = rows.select("grp", "node", F.explode("ps").alias("parent")).filter(F.col("parent").isNotNull()).distinct()
    nodes = rows.select("grp", "node").union(edges.select("grp", F.col("parent").alias("node"))).distinct()
    return edges, nodes


def _nearest(pairs: list[tuple[str, str, int]]) -> Iterator[tuple[str, str, int]]:
    """``(node, reached, least number of links)`` inside one fragment."""
    out: dict[str, list[tuple[str, int]]] = {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, w))
    for start, first in out.items():
        seen: dict[str, int] = {}
        heap = [(w, b) for b, w in first]
        heapq.heapify(heap)
        while heap:
            d, b = heapq.heappop(heap)
            if b in seen:
                continue
            seen[b] = d
            for c, w in out.get(b, ()):
                if c not in seen:
                    heapq.heappush(heap, (d + w, c))
        for b, d in seen.items():
            yield start, b, d


def _farthest(pairs: list[tuple[str, str, int]]) -> Iterator[tuple[str, str, int]]:
    """``(node, reached, most links)`` inside one fragment without cycles."""
    out: dict[str, list[tuple[str, int]]] = {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, w))
    done: dict[str, dict[str, int]] = {}
    for start in out:
        stack = [start]
        while stack:
            a = stack[-1]
            waits = [b for b, _ in out.get(a, ()) if b in out and b not in done]
            if waits:
                stack.extend(waits)
                continue
            stack.pop()
            if a not in done:
                far: dict[str, int] = {}
                for b, w in out[a]:
                    far[b] = max(far.get(b, 0), w)
                    for c, d in done.get(b, {}).items():
                        far[c] = max(far.get(c, 0), w + d)
                done[a] = far
    for a, far in done.items():
        for b, d in far.items():
            yield a, b, d


def _solver(solve: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Solves the fragments of a partition, which follow each other as it is sorted by fragment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, str, int]] = []
        at: tuple[str, int] | None = None
        rows: list[tuple] = []

        def solved() -> Iterator[pd.DataFrame]:
            nonlocal rows
            for a, b, d in solve(held):
                rows.append((*at, a, b, d))
                if len(rows) >= _BATCH:
                    yield pd.DataFrame(rows, columns=["grp", "frag", "node", "anc", "hops"])
                    rows = []

        for pdf in batches:
            for g, frag, a, b, w in zip(pdf.grp, pdf.frag, pdf.node, pdf.parent, pdf.hops, strict=True):
                if (g, frag) != at:
                    yield from solved()
                    at, held = (g, frag), []
                held.append((a, b, int(w)))
        yield from solved()
        if rows:
            yield pd.DataFrame(rows, columns=["grp", "frag", "node", "anc", "hops"])

    return run


def _spread(fragments: DataFrame) -> DataFrame:
    """Fragments whole in tasks.  A number of tasks keeps the optimizer from making one of them: few links may make many pairs."""
    tasks = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fragments.repartition(tasks, "grp", "frag").sortWithinPartitions("grp", "frag")


def _sized(edges: DataFrame) -> DataFrame:
    """``edges``, written once, with ``links``, the number of its group's."""
    edges = stored(edges)
    return edges.join(edges.groupBy("grp").agg(F.count("*").alias("links")), "grp")


def _heads_of(edges: DataFrame, level: int) -> DataFrame:
    """``(grp, node, head)`` of the nodes with links: the first head up the chain of one parent each,
    the one with the least hash of those with links of their own.  Where the way is longer than
    2 ** CLIMB links or runs in a circle, the node it has come to is as good as a head."""
    own = edges.select("grp", "node").distinct()
    up = (
        edges.join(own.withColumnRenamed("node", "parent"), ["grp", "parent"], "left_semi")
        .groupBy("grp", "node").agg(F.min(F.struct(F.xxhash64(F.lit(level), "parent").alias("h"), "parent")).alias("m")).select("grp", "node", F.col("m.parent").alias("up"))
    )
    is_head = F.pmod(F.xxhash64(F.lit(-1 - level), "node"), F.lit(HEADS)) == 0
    state = stored(own.join(up, ["grp", "node"], "left").select("grp", "node", F.when(is_head, F.col("node")).otherwise(F.coalesce("up", "node")).alias("head")))
    for _ in range(CLIMB):
        state = stored(state.join(state.select("grp", F.col("node").alias("head"), F.col("head").alias("next")), ["grp", "head"]).select("grp", "node", F.col("next").alias("head")))
    return state


def _cut(edges: DataFrame, limit: int, level: int) -> DataFrame:
    """``frag`` for the links of groups with more than ``limit`` links: that of the node's head, or
    a part of it by hash of the link where it has more than ``limit`` links itself."""
    headed = edges.join(_heads_of(edges, level), ["grp", "node"])
    size = headed.groupBy("grp", "head").agg(F.ceil(F.count("*") / limit).alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node", "parent"), F.col("parts"))).otherwise(F.lit(0))
    return headed.join(size, ["grp", "head"]).select("grp", "node", "parent", "hops", F.xxhash64("head", part).alias("frag"))


@dataclass
class Contraction:
    """One level: ``small`` are the pairs of groups that are one fragment each, and for the
    other groups ``local`` are the pairs inside fragments, ``exits`` those whose ``anc``
    has links in another fragment, ``quotient`` the links between nodes that are exits themselves."""

    small: DataFrame
    large: DataFrame | None = None
    local: DataFrame | None = None
    exits: DataFrame | None = None
    quotient: DataFrame | None = None
    n_large: int = 0
    n_quotient: int = 0


def contract(edges: DataFrame, fragment: int = FRAGMENT, level: int = 0, longest: bool = False) -> Contraction:
    """Contracts ``(grp, node, parent, hops)`` by one level."""
    run = _solver(_farthest if longest else _nearest)
    sized = _sized(edges.select("grp", "node", "parent", "hops"))
    few = sized.filter(F.col("links") <= fragment).select("grp", F.lit(0).cast("long").alias("frag"), "node", "parent", "hops")
    small = _spread(few).mapInPandas(run, _PAIRS).select("grp", "node", "anc", "hops")
    large = stored(sized.filter(F.col("links") > fragment).select("grp", "node", "parent", "hops"))
    n_large = large.count()
    if not n_large:
        return Contraction(small)
    parts = stored(_cut(large, fragment, level))
    local = stored(_spread(parts.select("grp", "frag", "node", "parent", "hops")).mapInPandas(run, _PAIRS))
    homes = parts.select("grp", F.col("node").alias("anc"), F.col("frag").alias("home")).distinct()
    exits = stored(local.join(homes, (local["grp"] == homes["grp"]) & (local["anc"] == homes["anc"]) & (local["frag"] != homes["home"]), "left_semi").select("grp", "node", "anc", "hops"))
    entered = exits.select("grp", F.col("anc").alias("node")).distinct()
    best = F.max if longest else F.min
    quotient = stored(exits.join(entered, ["grp", "node"], "left_semi").groupBy("grp", "node", F.col("anc").alias("parent")).agg(best("hops").alias("hops")))
    return Contraction(small, large, local.select("grp", "node", "anc", "hops"), exits, quotient, n_large, quotient.count())


def ancestors(edges: DataFrame, fragment: int = FRAGMENT, longest: bool = False) -> DataFrame:
    """``(grp, node, anc, hops)``: each node with each node it reaches, directly or
    through others, and the least number of links between them, with ``longest`` the most.

    ``edges`` has ``grp, node, parent`` and may have ``hops``.  A node on a
    cycle, or linked to itself, comes out with ``anc = node``; ``longest`` needs
    links without cycles.  No links give no rows.  ``fragment`` bounds the links
    a task holds.
    """
    if "hops" not in edges.columns:
        edges = edges.withColumn("hops", F.lit(1))
    return _ancestors(edges.select("grp", "node", "parent", "hops"), fragment, longest, 0)


def _ancestors(edges: DataFrame, fragment: int, longest: bool, level: int) -> DataFrame:
    c = contract(edges, fragment, level, longest)
    if c.large is None:
        return c.small
    best = F.max if longest else F.min
    if not c.n_quotient:
        ways = c.exits
    else:
        shrinks = 2 * c.n_quotient <= c.n_large
        beyond = _ancestors(c.quotient, fragment, longest, level + 1) if shrinks else _stepwise(c.quotient, longest)
        beyond = beyond.select("grp", F.col("node").alias("mid"), "anc", F.col("hops").alias("more"))
        ways = c.exits.unionByName(c.exits.withColumnRenamed("anc", "mid").join(beyond, ["grp", "mid"]).select("grp", "node", "anc", (F.col("hops") + F.col("more")).alias("hops")))
    ways = ways.groupBy("grp", "node", F.col("anc").alias("mid")).agg(best("hops").alias("hops"))
    inner = c.local.select("grp", F.col("node").alias("mid"), "anc", F.col("hops").alias("more"))
    through = ways.join(inner, ["grp", "mid"]).select("grp", "node", "anc", (F.col("hops") + F.col("more")).alias("hops"))
    return c.small.unionByName(c.local.unionByName(through).groupBy("grp", "node", "anc").agg(best("hops").alias("hops")))


def _stepwise(edges: DataFrame, longest: bool = False) -> DataFrame:
    """All pairs by adding one link at a time to the pairs that were new or better in the last round."""
    best, better = (F.max, F.col("hops") > F.col("had")) if longest else (F.min, F.col("hops") < F.col("had"))
    edges = stored(edges)
    step = edges.select("grp", F.col("node").alias("anc"), F.col("parent").alias("to"), F.col("hops").alias("more"))
    pairs = front = stored(edges.select("grp", "node", F.col("parent").alias("anc"), "hops"))
    while not front.isEmpty():
        ahead = front.join(step, ["grp", "anc"]).select("grp", "node", F.col("to").alias("anc"), (F.col("hops") + F.col("more")).alias("hops")).groupBy("grp", "node", "anc").agg(best("hops").alias("hops"))
        front = stored(ahead.join(pairs.withColumnRenamed("hops", "had"), ["grp", "node", "anc"], "left").filter(F.col("had").isNull() | better).drop("had"))
        pairs = stored(pairs.unionByName(front).groupBy("grp", "node", "anc").agg(best("hops").alias("hops")))
    return pairs


def hierarchy(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each node: ``depth`` (links to the nearest root), ``root`` (that
    root; the first by name of several), ``roots`` (all roots it reaches),
    ``parent`` (the first parent on the shortest way to ``root``), ``n_ancestors``,
    ``n_descendants``, ``cyclic``.

    A root has no parent: its depth is 0, its root itself.  A node that reaches
    no root (it only runs into a cycle) has null ``depth``, ``root`` and
    ``parent`` and an empty ``roots``.  ``pairs`` is what ``ancestors`` gives.
    """
    pairs = stored(pairs)
    below = edges.select("grp", F.col("node").alias("anc")).distinct().withColumn("linked", F.lit(True))
    at_root = F.col("linked").isNull()
    up = pairs.join(below, ["grp", "anc"], "left").groupBy("grp", "node").agg(
        F.count("*").alias("n_ancestors"), F.max(F.col("node") == F.col("anc")).alias("cyclic"),
        F.min(F.when(at_root, F.struct("hops", "anc"))).alias("near"), F.sort_array(F.collect_set(F.when(at_root, F.col("anc")))).alias("roots"),
    )
    down = pairs.groupBy("grp", F.col("anc").alias("node")).agg(F.count("*").alias("n_descendants"))
    # every node with links has pairs, so a node without is a root
    root = F.col("n_ancestors").isNull()
    known = stored(
        nodes.join(up, ["grp", "node"], "left").join(down, ["grp", "node"], "left").select(
            "grp", "node", F.when(root, 0).otherwise(F.col("near.hops")).alias("depth"), F.when(root, F.col("node")).otherwise(F.col("near.anc")).alias("root"),
            F.when(root, F.array("node")).otherwise(F.col("roots")).alias("roots"), F.coalesce("n_ancestors", F.lit(0)).alias("n_ancestors"),
            F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        )
    )
    # the nearest root of a node is that of the parent nearest to one
    near = known.filter("depth IS NOT NULL").select("grp", F.col("node").alias("parent"), F.col("depth").alias("d"), F.col("root").alias("r"))
    first = edges.select("grp", "node", "parent").join(near, ["grp", "parent"]).groupBy("grp", "node").agg(F.min(F.struct("d", "r", "parent")).alias("m")).select("grp", "node", F.col("m.parent").alias("parent"))
    return known.join(first, ["grp", "node"], "left").select("grp", "node", "depth", "root", "parent", "roots", "n_ancestors", "n_descendants", "cyclic")


_WAYS = "grp string, frag long, node string, anc string, way array<string>"


def _ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each node of a fragment the way up to the first node without a link in it."""
    names = ["grp", "frag", "node", "anc", "way"]
    held: dict[str, tuple[str, list[str]]] = {}
    at: tuple[str, int] | None = None
    rows: list[tuple] = []

    def solved() -> Iterator[pd.DataFrame]:
        nonlocal rows
        done: dict[str, tuple[str, list[str]]] = {}
        for start in held:
            chain, a = [], start
            while a in held and a not in done:
                chain.append(a)
                a = held[a][0]
            end, rest = done.get(a, (a, []))
            for b in reversed(chain):
                rest = held[b][1] + rest
                done[b] = (end, rest)
        for a, (end, way) in done.items():
            rows.append((*at, a, end, way))
            if len(rows) >= _BATCH // 8:
                yield pd.DataFrame(rows, columns=names)
                rows = []

    for pdf in batches:
        for g, frag, a, b, way in zip(pdf.grp, pdf.frag, pdf.node, pdf.parent, pdf.way, strict=True):
            if (g, frag) != at:
                yield from solved()
                at, held = (g, frag), {}
            held[a] = (b, list(way))
    yield from solved()
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _climb(steps: DataFrame, fragment: int, level: int) -> DataFrame:
    """``(grp, node, way)``: the nodes from each node of a forest up to, without, the root.

    ``steps`` has one row ``(grp, node, parent, way)`` for each node with a parent.
    The chains inside fragments are contracted, the quotient forest of the nodes
    that other fragments run into is solved the same way, and its ways are put behind the fragments' ways."""
    sized = _sized(steps)
    few = sized.filter(F.col("links") <= fragment).select("grp", F.lit(0).cast("long").alias("frag"), "node", "parent", "way")
    small = _spread(few).mapInPandas(_ways, _WAYS).select("grp", "node", "way")
    large = stored(sized.filter(F.col("links") > fragment).select("grp", "node", "parent", "way"))
    if large.isEmpty():
        return small
    parts = _cut(large.withColumn("hops", F.lit(1)), fragment, level).join(large.select("grp", "node", "way"), ["grp", "node"])
    local = stored(_spread(parts.select("grp", "frag", "node", "parent", "way")).mapInPandas(_ways, _WAYS).select("grp", "node", "anc", "way"))
    entered = local.select("grp", F.col("anc").alias("node")).distinct()
    quotient = stored(local.join(entered, ["grp", "node"], "left_semi").select("grp", "node", F.col("anc").alias("parent"), "way"))
    beyond = _climb(quotient, fragment, level + 1).select("grp", F.col("node").alias("anc"), F.col("way").alias("rest"))
    whole = local.join(beyond, ["grp", "anc"], "left").select("grp", "node", F.when(F.col("rest").isNull(), F.col("way")).otherwise(F.concat("way", "rest")).alias("way"))
    return small.unionByName(whole)


def paths(nodes: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """``path`` from each node of ``hierarchy`` to its root, as an array of nodes.  Nodes
    without a root have a null path.  The parents on the shortest ways form a forest, so each level of
    contraction leaves only the nodes that other fragments run into."""
    steps = nodes.filter("parent IS NOT NULL").select("grp", "node", "parent", F.array("node").alias("way"))
    ways = _climb(steps, fragment, 0)
    path = F.when(F.col("way").isNotNull(), F.concat("way", F.array("root"))).when(F.col("depth") == 0, F.array("node"))
    return nodes.join(ways, ["grp", "node"], "left").withColumn("path", path).drop("way")

