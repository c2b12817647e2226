"""Cliques, what they share, and percolation of edges and cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.numbering import numbered
from chronomotif.operators.components import connected
from chronomotif.operators.graphs import spanning_forest
from chronomotif.sources.nets import Graph
from chronomotif.storage import saved


#: Distinct weights at most that a percolation looks at one by one.
MOST_POINTS = 10_000


def k_cliques(graph: Graph, k: int) -> DataFrame:
    """``clique``: sorted arrays of ``k`` nodes that all have edges, each once.

    Edges go from the end of smaller degree to the larger, so that what a hub
    could reach is never listed from it.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    if k == 1:
        return graph.nodes.select(F.array("node").alias("clique"))
    deg = graph.both_ways().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("k"))
    a, b = deg.select(F.col("node").alias("u"), F.col("k").alias("ku")), deg.select(F.col("node").alias("v"), F.col("k").alias("kv"))
    first = F.struct(F.col("ku"), F.col("u")) < F.struct(F.col("kv"), F.col("v"))
    ways = graph.edges.join(a, "u").join(b, "v").select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"))
    ways = saved(ways, "clique-ways")
    level = ways.select(F.array("x", "y").alias("c"))
    for size in range(2, k):
        grown = level.join(ways, F.element_at("c", -1) == F.col("x"))
        for at in range(size - 1):
            other = ways.select(F.col("x").alias("p"), F.col("y").alias("q"))
            grown = grown.join(other, (F.col("c")[at] == F.col("p")) & (F.col("y") == F.col("q")), "left_semi")
        level = grown.select(F.concat("c", F.array("y")).alias("c"))
    return level.select(F.array_sort("c").alias("clique"))


def intensities(graph: Graph, cliques: DataFrame, variant: str = "standard") -> DataFrame:
    """``clique, intensity, least``: the mean of the weights (geometric) and the least.

    ``variant="reference"`` takes both directions' product under the root
    k*floor((k-1)/2), which for even k isn't the number of pairs.
    """
    pairs = cliques.select("clique", F.explode("clique").alias("u")).select("clique", "u", F.explode("clique").alias("v")).filter("u < v")
    sums = pairs.join(graph.edges, ["u", "v"]).groupBy("clique").agg(F.sum(F.ln("w")).alias("s"), F.min("w").alias("least"))
    k = F.size("clique")
    root = k * (k - 1) / 2 if variant == "standard" else k * F.greatest(F.floor((k - 1) / 2), F.lit(1)) / 2
    return sums.select("clique", F.exp(F.col("s") / root).alias("intensity"), "least")


def _subcliques(cliques: DataFrame) -> DataFrame:
    return cliques.select("clique", F.explode(F.transform("clique", lambda x: F.array_except("clique", F.array(x)))).alias("sub"))


def clique_incidence(cliques: DataFrame) -> DataFrame:
    """``clique, sub``: the sub-cliques of one node less."""
    return _subcliques(cliques)


def clique_network(cliques: DataFrame, shared: int | None = None) -> DataFrame:
    """``a, b``: cliques that share all but one node, or at least so many."""
    if shared is None:
        subs = _subcliques(cliques)
        other = subs.select(F.col("clique").alias("b"), "sub")
        return subs.select(F.col("clique").alias("a"), "sub").join(other, "sub").filter("a < b").select("a", "b").distinct()
    ends = cliques.select(F.col("clique").alias("a"), F.explode("clique").alias("node"))
    other = ends.select(F.col("a").alias("b"), "node")
    both = ends.join(other, "node").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.filter(F.col("n") >= shared).select("a", "b")


def clique_communities(cliques: DataFrame) -> DataFrame:
    """``node, comm``: nodes of cliques that hang together by sub-cliques; a node can be in several. Communities are numbered by size."""
    name = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    subs = saved(_subcliques(cliques).select("clique", name(F.col("sub")).alias("sub")), "subcliques")
    least = subs.groupBy("clique").agg(F.min("sub").alias("least"))
    comp = connected(subs.join(least, "clique").select(F.col("sub").alias("u"), F.col("least").alias("v")))
    member = least.join(comp, F.col("least") == F.col("node")).select(F.explode("clique").alias("node"), "comp").distinct()
    return by_size(member, "comp")


def by_size(member: DataFrame, group: str) -> DataFrame:
    """``node, comm``: groups numbered from 0 by size, the largest first, then by their least node."""
    sizes = member.groupBy(group).agg(F.count("*").alias("n"), F.min("node").alias("first"))
    return member.join(numbered(sizes, [F.desc("n"), "first", group], "comm").select(group, "comm"), group).select("node", "comm")


def component_communities(graph: Graph) -> DataFrame:
    """``node, comm`` of connected components; lone nodes are components."""
    comp = connected(graph.edges)
    full = graph.nodes.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    return by_size(full, "comp")


def is_connected(graph: Graph) -> bool:
    return component_communities(graph).agg(F.max("comm")).first()[0] in (0, None)


def evaluations(graph: Graph, kind: str = "weights", points: list[float] | int = 10) -> list[float]:
    """Weights at which a percolation is looked at.

    ``weights``: each; ``abslist`` and ``fraclist``: given weights, or shares of
    edges; ``abslinear`` and ``fraclinear``: so many evenly spaced.
    """
    if kind == "weights":
        found = [r["w"] for r in graph.edges.select("w").distinct().limit(MOST_POINTS + 1).collect()]
        if len(found) > MOST_POINTS:
            raise ValueError(f"the edges have more than {MOST_POINTS} weights: choose points of another kind")
        return sorted(found)
    if kind == "abslist":
        return list(points)
    lo, hi = graph.edges.agg(F.min("w"), F.max("w")).first()
    if lo is None:
        return []
    if kind == "abslinear":
        return [lo + (hi - lo) * k / max(points - 1, 1) for k in range(points)]
    shares = list(points) if kind == "fraclist" else [k / max(points - 1, 1) for k in range(points)]
    if kind not in ("fraclist", "fraclinear"):
        raise ValueError(f"unknown kind {kind!r}")
    return list(graph.edges.agg(F.percentile("w", F.array(*(F.lit(float(s)) for s in shares)))).first()[0])


def edge_percolation(graph: Graph, at: list[float], reverse: bool = False) -> DataFrame:
    """``bound, node, comm``: components of the edges of weight up to each bound, or from it if ``reverse``.

    A spanning forest has the same components at every bound, so it is made
    once and cut at each.
    """
    forest = saved(spanning_forest(graph, maximum=reverse), "percolation")
    out = None
    for bound in at:
        kept = forest.filter(F.col("w") >= bound if reverse else F.col("w") <= bound)
        part = component_communities(Graph(kept, graph.nodes)).select(F.lit(float(bound)).alias("bound"), "node", "comm")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no bounds")
    return out


def clique_percolation(graph: Graph, k: int, at: list[float], weight: str = "intensity", reverse: bool = True) -> DataFrame:
    """``bound, node, comm``: communities of the k-cliques whose weight (``intensity`` or ``least``) reaches each bound."""
    cliques = saved(intensities(graph, k_cliques(graph, k)), "weighted-cliques")
    out = None
    for bound in at:
        kept = cliques.filter(F.col(weight) >= bound if reverse else F.col(weight) <= bound)
        part = clique_communities(kept.select("clique")).select(F.lit(float(bound)).alias("bound"), "node", "comm")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no bounds")
    return out
