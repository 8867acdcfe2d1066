from __future__ import annotations

import random

import pytest

from loomfold.operators import graph
from loomfold.operators.hierarchy import ancestors, contract, hierarchy, links, paths


def brute(edges):
    out, res = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for s in out:
        seen, front, d = {}, [s], 0
        while front:
            d += 1
            front = [b for a in front for b in out.get(a, ()) if b not in seen and not seen.update({b: d})]
        res.update({(s, b): d for b, d in seen.items()})
    return res


@pytest.mark.parametrize("limit", [8, 30, 1000])
@pytest.mark.parametrize("seed", [0, 1])
def test_closure_is_the_same_for_all_fragment_sizes(spark, seed, limit):
    r = random.Random(seed)
    edges = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(45)} | {(f"c{i}", f"c{i + 1}") for i in range(25)}
    df = spark.createDataFrame([("g", a, b) for a, b in edges], "grp string, node string, parent string")
    assert {(x.node, x.anc): x.hops for x in ancestors(df, limit).collect()} == brute(edges)


def test_links_nulls_repeats_and_clashing_columns(spark):
    rows = [("f", "a", ["b", None, "b"], 1), ("f", "a", ["c"], 2), ("f", "b", None, 3), (None, "x", ["y"], 4), ("f", None, ["z"], 5), ("f", "b", [], 6)]
    e, n = links(spark.createDataFrame(rows, "src string, code string, pre array<string>, grp int"), "src", "code", "pre")
    assert sorted(map(tuple, e.collect())) == [("f", "a", "b"), ("f", "a", "c")]
    assert sorted(x.node for x in n.collect()) == ["a", "b", "c"]


def test_hierarchy_paths_and_cycles(spark):
    edges = [("g", "d", "b"), ("g", "d", "c"), ("g", "b", "a"), ("g", "c", "a"), ("g", "x", "y"), ("g", "y", "x"), ("g", "z", "x"), ("g", "s", "s")]
    e = spark.createDataFrame(edges, "grp string, node string, parent string")
    n = e.select("grp", "node").union(e.select("grp", "parent")).distinct()
    p = ancestors(e)
    h = {r.node: r for r in paths(hierarchy(e, n, p)).collect()}
    assert (h["d"].depth, h["d"].root, h["d"].parent, h["d"].path) == (2, "a", "b", ["d", "b", "a"])
    assert (h["a"].depth, h["a"].path, h["a"].n_descendants, h["a"].cyclic) == (0, ["a"], 3, False)
    assert h["x"].cyclic and h["y"].cyclic and h["s"].cyclic and not h["z"].cyclic
    assert h["z"].depth is None and h["z"].path is None and h["z"].roots == []
    assert {r.node: r.cycle for r in graph.cycle_members(p).collect()} == {"x": "x", "y": "x", "s": "s"}
    assert [(r.node, r.level) for r in graph.chain_order(e, p).orderBy("ord").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_no_links(spark):
    e = spark.createDataFrame([], "grp string, node string, parent string")
    assert ancestors(e).count() == 0


def _shapes():
    r = random.Random(7)
    chain = {(f"c{i}", f"c{i + 1}") for i in range(700)}
    tree = {(f"t{i}", f"t{(i - 1) // 3}") for i in range(1, 800)}
    star = {(f"s{i}", "s") for i in range(700)} | {("s", "z")}
    fan = {("f", f"p{i}") for i in range(400)} | {(f"p{i}", "q") for i in range(400)}
    ring = {(f"r{i}", f"r{(i + 1) % 300}") for i in range(300)}
    woven = {(f"w{i}", f"w{r.randrange(i)}") for i in range(1, 300) for _ in range(3)}
    return {"chain": chain, "tree": tree, "star": star, "fan": fan, "ring": ring, "woven": woven}


@pytest.mark.parametrize("limit", [64, 256])
def test_closure_of_shapes_through_the_quotient(spark, limit):
    shapes = _shapes()
    df = spark.createDataFrame([(g, a, b) for g, es in shapes.items() for a, b in es], "grp string, node string, parent string")
    got = {(x.grp, x.node, x.anc): x.hops for x in ancestors(df, limit).collect()}
    assert got == {(g, *k): v for g, es in shapes.items() for k, v in brute(es).items()}


@pytest.mark.parametrize("limit", [64, 256])
def test_a_long_chain_and_a_broad_tree_shrink(spark, limit):
    n = 100_000
    chain = spark.range(n).selectExpr("'chain' AS grp", "concat('c', id) AS node", "concat('c', id + 1) AS parent", "1 AS hops")
    tree = spark.range(1, n).selectExpr("'tree' AS grp", "concat('t', id) AS node", "concat('t', (id - 1) DIV 50) AS parent", "1 AS hops")
    c = contract(chain.union(tree), limit)
    left = {r.grp: r["count"] for r in c.quotient.groupBy("grp").count().collect()}
    assert 0 < left["chain"] < 0.2 * n and 0 < left["tree"] < 0.1 * n
    assert c.small.count() == 0


def test_longest_ways(spark):
    r = random.Random(3)
    edges = {(f"w{i}", f"w{r.randrange(i)}") for i in range(1, 200) for _ in range(2)}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    far: dict = {}
    for i in range(200):
        a = f"w{i}"
        far[a] = {}
        for b in out.get(a, ()):
            for c, d in {b: 0, **far[b]}.items():
                far[a][c] = max(far[a].get(c, 0), d + 1)
    df = spark.createDataFrame([("g", a, b) for a, b in edges], "grp string, node string, parent string")
    assert {(x.node, x.anc): x.hops for x in ancestors(df, 64, longest=True).collect()} == {(a, b): d for a, m in far.items() for b, d in m.items()}


def test_paths_of_a_long_chain_and_a_tree(spark):
    edges = [("chain", f"c{i}", f"c{i + 1}") for i in range(900)] + [("tree", f"t{i}", f"t{(i - 1) // 2}") for i in range(1, 900)]
    e = spark.createDataFrame(edges, "grp string, node string, parent string")
    n = e.select("grp", "node").union(e.select("grp", "parent")).distinct()
    h = {r.node: r for r in paths(hierarchy(e, n, ancestors(e, 100)), 100).collect()}
    up = {a: b for _, a, b in edges}
    for a, r in h.items():
        way = [a]
        while way[-1] in up:
            way.append(up[way[-1]])
        assert (r.path, r.depth, r.root) == (way, len(way) - 1, way[-1])
