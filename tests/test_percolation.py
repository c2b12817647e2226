import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronomotif.functions import ordering
from chronomotif.operators import percolation
from chronomotif.sources.nets import Graph


def parts_of(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[root(a)] = root(b)
    sizes = {}
    for n in nodes:
        sizes[root(n)] = sizes.get(root(n), 0) + 1
    return sorted(sizes.values())


def row(w, sizes):
    top, n = max(sizes, default=0), sum(sizes)
    squares = sum(s * s for s in sizes)
    return (w, n, len(sizes), top, squares, pytest.approx((squares - top * top) / (n - top) if n > top else 0.0))


@pytest.mark.parametrize("reverse,weights", [(False, 9), (True, 9), (True, 1), (False, 200)])
def test_components_at_every_weight(spark, reverse, weights):
    rnd = random.Random(weights)
    edges = {tuple(sorted(rnd.sample(range(60), 2))): float(rnd.randint(1, weights)) for _ in range(70)}
    graph = Graph.of(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()] + [(99, 99, 1.0)], "u long, v long, w double"))
    nodes = [r["node"] for r in graph.nodes.collect()]
    got = [tuple(r) for r in percolation.edge_profile(graph, reverse).orderBy("w").collect()]
    kept = lambda bound: [e for e, w in edges.items() if (w >= bound if reverse else w <= bound)]
    assert got == [row(w, parts_of(nodes, kept(w))) for w in sorted(set(edges.values()))]


def test_cliques_at_every_weight(spark):
    """More nodes than a net of nations has: 40, with triangles that share one node only, and ties."""
    rnd = random.Random(3)
    edges = {e: float(rnd.randint(1, 6)) for e in combinations(range(40), 2) if rnd.random() < 0.2}
    graph = Graph.of(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double"))
    got = [tuple(r) for r in percolation.clique_profile(graph, 3, "least").orderBy("w").collect()]
    weight = {t: min(edges[p] for p in combinations(t, 2)) for t in combinations(range(40), 3) if all(p in edges for p in combinations(t, 2))}
    want = []
    for bound in sorted(set(weight.values())):
        kept = [t for t, w in weight.items() if w >= bound]
        want.append(row(bound, parts_of(kept, [(a, b) for a, b in combinations(kept, 2) if len({*a} & {*b}) == 2])))
    assert len(want) > 3 and got == want


def test_merge_tree_of_a_chain(spark):
    """Every merge has its children's sizes; names are the least nodes."""
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (3, 4, 5.0), (8, 9, 1.0)], "u long, v long, w double")
    got = {tuple(r) for r in percolation.merge_tree(edges).collect()}
    assert got == {(1.0, 8, 8, 1), (1.0, 8, 9, 1), (4.0, 2, 2, 1), (4.0, 2, 3, 1), (5.0, 1, 1, 1), (5.0, 1, 2, 2), (5.0, 1, 4, 1)}
    none = Graph(edges.filter("w < 0"), spark.range(3).withColumnRenamed("id", "node"))
    assert percolation.edge_profile(none).count() == 0


def test_running_sums_over_ranges(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("o"), F.col("id").alias("s"), (F.col("id") % 91).alias("m"))
    got = ordering.running(rows, [F.desc("o")], ["s"], ["m"]).orderBy(F.desc("o")).collect()
    total, top = 0, 0
    for r, x in zip(got, sorted(rows.collect(), key=lambda r: -r["o"]), strict=True):
        total, top = total + x["s"], max(top, x["m"])
        assert (r["o"], r["s"], r["m"]) == (x["o"], total, top)
