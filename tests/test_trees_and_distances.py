import random
from collections import Counter

import pytest

from chronomotif.operators import communities, graphs
from chronomotif.sources.nets import Graph


def random_tree(seed, levels):
    """``(level, comm) -> parent`` with chains, early leaves and, below the top, communities without a parent."""
    rnd = random.Random(seed)
    rows = {(0, c): None for c in range(rnd.randint(1, 3))}
    for level in range(1, levels):
        above = [c for lv, c in rows if lv == level - 1]
        comm = 0
        for c in above:
            for _ in range(rnd.choice([0, 1, 1, 1, 2, 3])):
                rows[level, comm] = c
                comm += 1
        if rnd.random() < 0.4:
            rows[level, comm] = None
    return rows


def order_of(rows, levels):
    kids = lambda lv, c: sorted(k for (level, k), p in rows.items() if level == lv + 1 and p == c)
    leaves = lambda lv, c: sum(leaves(lv + 1, k) for k in kids(lv, c)) or 1
    out, end = {}, 0

    def put(lv, c, at):
        out[lv, c] = (at, leaves(lv, c))
        for k in kids(lv, c):
            put(lv + 1, k, at)
            at += leaves(lv + 1, k)

    for level in range(levels):
        for c in sorted(c for (lv, c), p in rows.items() if lv == level and p is None):
            put(level, c, end)
            end += leaves(level, c)
    return out


def thinned_of(rows):
    deg = {n: (rows[n] is not None) + sum(lv == n[0] + 1 and p == n[1] for (lv, _), p in rows.items()) for n in rows}
    up = lambda n: None if rows[n] is None else (n[0] - 1, rows[n])
    gone = {n for n in rows if deg[n] == 2 and up(n) and deg[up(n)] == 2}
    out = {}
    for n in set(rows) - gone:
        p = up(n)
        while p in gone:
            p = up(p)
        out[n] = p
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_recursion(spark, seed):
    levels = 5 + seed % 2
    rows = random_tree(seed, levels)
    tree = spark.createDataFrame([(lv, c, p) for (lv, c), p in rows.items()], "level int, comm long, parent long")
    got = {(r["level"], r["comm"]): (r["first"], r["leaves"]) for r in communities.tree_order(tree, levels).collect()}
    assert got == order_of(rows, levels)
    thin = {(r["level"], r["comm"]): None if r["parent"] is None else (r["parent_level"], r["parent"]) for r in communities.thinned(tree, levels).collect()}
    assert thin == thinned_of(rows)


def distances(edges):
    ways = {}
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)
    out = Counter()
    for s in ways:
        seen, front, d = {s}, {s}, 0
        while front:
            d += 1
            front = set().union(*(ways[x] for x in front)) - seen
            seen |= front
            out[d] += len(front)
    return {d: n for d, n in out.items() if n}


@pytest.mark.parametrize("nodes,links,registers,error", [(60, 70, 12, 0), (1500, 2600, 8, 0.08)])
def test_distances_from_all_nodes(spark, nodes, links, registers, error):
    """Exact while sketches are sparse; within their error with 256 registers and 1,500 nodes to reach."""
    rnd = random.Random(nodes)
    edges = {tuple(sorted(rnd.sample(range(nodes), 2))) for _ in range(links)}
    graph = Graph.of(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double"))
    got = {r["dist"]: r["pairs"] for r in graphs.neighbourhood_sizes(graph, registers).collect()}
    want = distances(edges)
    if not error:
        assert got == want
    total = sum(want.values())
    for d in want:
        assert abs(sum(n for k, n in got.items() if k <= d) - sum(n for k, n in want.items() if k <= d)) <= error * total
    mean = lambda x: sum(d * n for d, n in x.items()) / sum(x.values())
    assert mean(got) == pytest.approx(mean(want), rel=max(error, 1e-9))
    assert {r["dist"] for r in graphs.neighbourhood_sizes(graph, registers, most=2).collect()} == {1, 2}


@pytest.mark.parametrize("directed", [False, True])
def test_drawn_betweenness_is_within_its_error(spark, directed):
    """Against all shortest paths: a net with hubs, several paths of one length, and a part of its own; the same again by the same seed."""
    rnd = random.Random(12)
    edges = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(70)} | {(0, k) for k in range(1, 30, 3)} | {(50, 51), (51, 52)}
    if directed:
        edges = {(a, b) if rnd.random() < 0.5 else (b, a) for a, b in edges}
    graph = Graph.of(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double"), directed=directed)
    n = graph.nodes.count()
    exact = {r["node"]: r["betweenness"] / (n * (n - 1) * (1 if directed else 0.5)) for r in graphs.betweenness(graph).collect()}
    drawn = {r["node"]: r["share"] for r in graphs.drawn_betweenness(graph, 3, error=0.06).collect()}
    assert set(drawn) == set(exact) and max(exact.values()) > 0.03
    assert max(abs(drawn[k] - exact[k]) for k in exact) <= 0.06
    if not directed:
        assert drawn == {r["node"]: r["share"] for r in graphs.drawn_betweenness(graph, 3, error=0.06).collect()}


def test_drawn_betweenness_of_few_nodes(spark):
    line = Graph.of(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "u long, v long, w double"))
    got = {r["node"]: r["share"] for r in graphs.drawn_betweenness(line, 1, error=0.1).collect()}
    assert got[1] == got[3] == 0 and abs(got[2] - 1 / 3) <= 0.1
    two = Graph.of(spark.createDataFrame([(1, 2, 1.0)], "u long, v long, w double"))
    assert {r["betweenness"] for r in graphs.drawn_betweenness(two, 1).collect()} == {0.0}
