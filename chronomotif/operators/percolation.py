"""Percolation at every weight at once: a merge tree of components, and what runs along it.

The weights are halved again and again. Edges of a segment's lighter half stay
with the segment's nodes; its heavier half sees what the lighter one joined as
single nodes. All segments of a depth are components of one table, so that the
tree takes as many runs of components as the number of weights has binary
digits, each over every edge at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.numbering import numbered
from chronomotif.functions.ordering import running
from chronomotif.operators.cliques import intensities, k_cliques
from chronomotif.operators.components import connected
from chronomotif.sources.nets import Graph
from chronomotif.storage import released, saved


def _joined(edges: DataFrame) -> DataFrame:
    """``seg, node, comp`` of the components within each segment, of nodes that have edges."""
    tagged = lambda c: F.struct("seg", F.col(c).alias("node"))
    comp = connected(edges.select(tagged("u").alias("u"), tagged("v").alias("v")))
    return comp.select(F.col("node.seg").alias("seg"), F.col("node.node").alias("node"), F.col("comp.node").alias("comp"))


def _once(edges: DataFrame) -> DataFrame:
    """Of edges between the same two nodes the first, in either direction; none from a node to itself."""
    flat = edges.filter("u <> v").select("seg", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "r")
    return flat.groupBy("seg", "u", "v").agg(F.min("r").alias("r"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("seg", F.explode(F.array("u", "v")).alias("node")).distinct()


def merge_tree(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """``w, comp, child, size``: at a weight, components ``child`` of so many nodes become one, ``comp``.

    ``edges`` has ``u, v, w``; they come in order of weight, the lightest first,
    or the heaviest if ``reverse``. Components are named by their least nodes, so
    that one child has its parent's name. Edges of one weight merge together.
    """
    order = F.desc("w") if reverse else F.asc("w")
    ranks = saved(numbered(edges.select("w").distinct(), [order], "r"), "weight-ranks")
    bits = max(ranks.count() - 1, 0).bit_length()
    rows = saved(_once(edges.join(ranks, "w").select(F.lit(0).cast("long").alias("seg"), "u", "v", "r")), "merge-edges")
    sizes = saved(_ends(rows).withColumn("size", F.lit(1).cast("long")), "merge-sizes")
    for depth in range(bits):
        left = bits - depth - 1
        heavy = F.shiftright("r", left).bitwiseAND(F.lit(1)) == 1
        comp = saved(_joined(rows.filter(~heavy)), "merge-joined")
        end = lambda c: comp.select("seg", F.col("node").alias(c), F.col("comp").alias(f"{c}_in"))  # noqa: E731, B023
        upper = rows.filter(heavy).join(end("u"), ["seg", "u"], "left").join(end("v"), ["seg", "v"], "left")
        upper = _once(upper.select("seg", F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v"), "r"))
        new = saved(rows.filter(~heavy).select("seg", "u", "v", "r").unionByName(upper).withColumn("seg", F.shiftright("r", left)), "merge-edges")
        inside = sizes.join(comp, ["seg", "node"], "left").groupBy("seg", F.coalesce("comp", "node").alias("node")).agg(F.sum("size").alias("size"))
        both = sizes.withColumn("seg", 2 * F.col("seg")).unionByName(inside.withColumn("seg", 2 * F.col("seg") + 1))
        new_sizes = saved(both.join(_ends(new), ["seg", "node"], "left_semi"), "merge-sizes")
        released(rows, sizes, comp)
        rows, sizes = new, new_sizes
    merged = _joined(rows).join(sizes, ["seg", "node"]).join(ranks, F.col("seg") == F.col("r"))
    return merged.select("w", "comp", F.col("node").alias("child"), "size")


def profile(tree: DataFrame, weights: DataFrame, born: DataFrame | None = None, nodes: int = 0, reverse: bool = False) -> DataFrame:
    """``w, nodes, components, giant, squares, susceptibility`` at each of the ``weights`` (``w``, distinct), edges up to it taken.

    ``nodes`` are there from the start; ``born`` (``w, n``) tells how many more
    come with a weight. The susceptibility is the sum of squared sizes without
    the largest component, by the number of nodes outside it, 0 where none are.
    """
    merges = tree.groupBy("w", "comp").agg(F.count("*").alias("k"), F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("q"))
    steps = merges.groupBy("w").agg(F.sum(F.col("k") - 1).alias("gone"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("grown"), F.max("s").alias("top"))
    rows = weights.join(steps, "w", "left")
    rows = rows.join(born, "w", "left") if born is not None else rows.withColumn("n", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = rows.select("w", *(zero(c) for c in ("gone", "grown", "top", "n")))
    run = running(rows, [F.desc("w") if reverse else F.asc("w")], sums=["gone", "grown", "n"], maxima=["top"])
    there = F.lit(nodes) + F.col("n")
    giant = F.greatest(F.col("top"), F.when(there > 0, 1).otherwise(0))
    out = run.select("w", there.alias("nodes"), (there - F.col("gone")).alias("components"), giant.cast("long").alias("giant"), (there + F.col("grown")).alias("squares"))
    rest = F.col("nodes") - F.col("giant")
    return out.withColumn("susceptibility", F.when(rest > 0, (F.col("squares") - F.col("giant") * F.col("giant")) / rest).otherwise(0.0))


def edge_profile(graph: Graph, reverse: bool = False) -> DataFrame:
    """:func:`profile` of the network's components as its edges come, at each of its weights."""
    edges = saved(graph.edges.select("u", "v", "w"), "percolating")
    return profile(merge_tree(edges, reverse), edges.select("w").distinct(), nodes=graph.nodes.count(), reverse=reverse)


def clique_links(cliques: DataFrame, weight: Column, reverse: bool = True) -> DataFrame:
    """``u, v, w``: cliques to the one of each shared sub-clique that comes first; a link comes with the later of both.

    What hangs together by sub-cliques does so by these links at every bound,
    and there are no more of them than sub-cliques of cliques.
    """
    name = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    came = -weight if reverse else weight
    subs = cliques.select(name(F.col("clique")).alias("u"), weight.alias("w"), came.alias("came"), F.explode(F.transform("clique", lambda x: F.array_except("clique", F.array(x)))).alias("sub"))
    subs = subs.withColumn("sub", name(F.col("sub")))
    first = subs.groupBy("sub").agg(F.min(F.struct("came", "u")).alias("first"))
    return subs.join(first, "sub").select("u", F.col("first.u").alias("v"), "w").filter("u <> v")


def clique_profile(graph: Graph, k: int, weight: str = "intensity", reverse: bool = True) -> DataFrame:
    """:func:`profile` of the k-cliques that hang together by shared sub-cliques, as they come by ``intensity`` or ``least``; its nodes are cliques."""
    cliques = saved(intensities(graph, k_cliques(graph, k)).select("clique", F.col(weight).alias("w")), "weighted-cliques")
    tree = merge_tree(saved(clique_links(cliques, F.col("w"), reverse), "clique-links"), reverse)
    return profile(tree, cliques.select("w").distinct(), cliques.groupBy("w").agg(F.count("*").alias("n")), reverse=reverse)
