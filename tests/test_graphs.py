import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronomotif.functions import infotheory, stats
from chronomotif.operators import cliques, communities, graphs, shuffles
from chronomotif.sources.nets import Graph


@pytest.fixture(scope="module")
def small(spark):
    return Graph.of(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 3.0), (3, 4, 4.0), (5, 6, 5.0)], "u long, v long, w double"))


@pytest.fixture(scope="module")
def dense(spark):
    rnd = random.Random(1)
    edges = [(a, b, float(rnd.randint(1, 9))) for a, b in combinations(range(9), 2) if rnd.random() < 0.6]
    return Graph.of(spark.createDataFrame(edges, "u long, v long, w double")), edges


def test_measures(small):
    assert small.edges.count() == 5
    deg = {r["node"]: r["degree"] for r in graphs.degrees(small).collect()}
    strength = {r["node"]: r["strength"] for r in graphs.strengths(small).collect()}
    assert deg[1] == 2 and strength[1] == 4.0
    sizes = communities.size_distribution(cliques.component_communities(small)).collect()
    assert {r["size"]: r["n"] for r in sizes} == {2: 1, 4: 1}
    assert small.edges.agg(F.sum("w")).first()[0] == 15.0


def test_spanning_forest(small, dense):
    assert sorted(tuple(r) for r in graphs.spanning_forest(Graph(small.edges.filter("w <= 3"), small.nodes)).collect()) == [(1, 2, 1.0), (2, 3, 2.0)]
    g, edges = dense
    parent = list(range(9))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    total = 0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    assert graphs.spanning_forest(g).agg(F.sum("w")).first()[0] == total


def test_cliques(dense):
    g, edges = dense
    have = {(a, b) for a, b, _ in edges}
    for k in (2, 3, 4):
        want = {c for c in combinations(range(9), k) if all(p in have for p in combinations(c, 2))}
        assert {tuple(r["clique"]) for r in cliques.k_cliques(g, k).collect()} == want
    assert cliques.intensities(g, cliques.k_cliques(g, 3)).filter("intensity < least").count() == 0


def test_paths_and_betweenness(spark):
    path = Graph.of(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "u long, v long, w double"))
    d = {(r["start"], r["node"]): r["dist"] for r in graphs.path_lengths(path, path.nodes).collect()}
    assert d[1, 4] == 3 and d[2, 1] == 1 and (1, 1) not in d
    assert {r["node"]: r["betweenness"] for r in graphs.betweenness(path).collect()} == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}
    assert {(r["u"], r["v"]): r["betweenness"] for r in graphs.betweenness(path, edges=True).collect()} == {(1, 2): 3.0, (2, 3): 4.0, (3, 4): 3.0}


def test_communities(spark, small):
    rows = [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2)]
    a = spark.createDataFrame(rows, "node long, comm long")
    same = communities.compared(a, a).first()
    assert same["normalised"] == pytest.approx(1) and same["distance"] == pytest.approx(0)
    assert communities.variation_of_information(a, a, 6).first()[0] == pytest.approx(0)
    assert communities.susceptibility(a).first()[0] == pytest.approx(5 / 3)
    assert communities.chi(a).first()[0] == pytest.approx(9 / 5)
    w2 = 2 * 15.0
    s = {1: 4.0, 2: 3.0, 3: 9.0, 4: 4.0, 5: 5.0, 6: 5.0}
    comm = dict(rows)
    inner = sum(w for u, v, w in [(1, 2, 1), (2, 3, 2), (3, 1, 3)])
    standard = 2 * inner / w2 - sum(sum(s[n] for n in s if comm[n] == c) ** 2 for c in range(3)) / w2**2
    assert communities.modularity(small, a).first()[0] == pytest.approx(standard)
    pairs = sum(s[x] * s[y] for x, y in combinations(s, 2) if comm[x] == comm[y])
    assert communities.modularity(small, a, "reference").first()[0] == pytest.approx(inner / w2 - pairs / w2**2)
    top = spark.createDataFrame([(n, 0) for n in range(1, 6)], "node long, comm long")
    mid = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)], "node long, comm long")
    low = spark.createDataFrame([(n, n - 1) for n in range(1, 6)], "node long, comm long")
    tree = {}
    for r in communities.hierarchy([top, mid, low]).orderBy("level", "comm").collect():
        tree.setdefault(r["level"], []).append(r["parent"])
    assert tree == {0: [None], 1: [0, 0], 2: [0, 0, 0, 1, 1]}


def test_transforms(spark, small):
    assert graphs.threshold(small, 3, "<").edges.count() == 2
    assert graphs.snowball(small, spark.createDataFrame([(4,)], "node long"), 1).edges.count() == 1
    g, names = graphs.reindexed(small)
    assert sorted(r["node"] for r in g.nodes.collect()) == list(range(6)) and names.count() == 6
    rewired = shuffles.configuration_model(small.edges, 1)
    ends = lambda df: sorted(r[0] for r in df.select(F.explode(F.array("u", "v"))).collect())
    assert ends(rewired) == ends(small.edges)


def test_information(spark):
    dist = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.25), ("b", "y", 0.25), ("c", "y", 0.0)], "a string, b string, p double")
    assert infotheory.entropy(dist).first()[0] == pytest.approx(1.5)
    assert infotheory.normalised_entropy(dist).first()[0] == pytest.approx(1.5 / 1.5849625007211562)
    assert infotheory.conditional_entropy(dist, ["b"]).first()[0] == pytest.approx(0.75 * 0.9182958340544896)
    values = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    assert stats.percentile(values, "v", 0.25).first()[0] == pytest.approx(1.75)
    assert {r["value"]: r["share"] for r in stats.cumulative(values, "v").collect()} == {1.0: 1.0, 2.0: 0.75, 4.0: 0.5, 10.0: 0.25}


def test_paths_from_every_node_over_every_edge(spark):
    """Brute force over a network with weak edges, a long chain and two components; and samples of starts."""
    from chronomotif import registry

    rnd = random.Random(5)
    pairs = {(a, b) for a, b in combinations(range(12), 2) if rnd.random() < 0.2} | {(k, k + 1) for k in range(20, 36)}
    g = Graph.of(spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "u long, v long, w double"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        seen, front, d = {s}, {s}, 0
        while front:
            d, front = d + 1, {x for k in front for x in near[k]} - seen
            seen |= front
            want |= {(s, x): d for x in front}
    assert {(r["start"], r["node"]): r["dist"] for r in registry._whole_lengths(g).collect()} == want
    assert max(want.values()) == 16
    few = graphs.sampled_starts(g, 3, 1).collect()
    assert len(few) == 3 and few == graphs.sampled_starts(g, 3, 1).collect()
    assert graphs.sampled_starts(g, 0).count() == len(near)
