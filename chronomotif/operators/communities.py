"""Communities (``node, comm``; in a partition every node once): sizes, quality, comparison, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.ordering import running
from chronomotif.sources.nets import Graph
from chronomotif.storage import saved


def sizes(member: DataFrame) -> DataFrame:
    """``comm, size``."""
    return member.groupBy("comm").agg(F.count("*").alias("size"))


def size_distribution(member: DataFrame) -> DataFrame:
    """``size, n``."""
    return sizes(member).groupBy("size").agg(F.count("*").alias("n"))


def giant(member: DataFrame) -> DataFrame:
    """One row, ``size`` of the largest."""
    return sizes(member).agg(F.max("size").alias("size"))


def susceptibility(member: DataFrame, n_nodes: int | None = None, all_giants: bool = False) -> DataFrame:
    """One row, ``susceptibility``: the sum of squared sizes without the giant, by the number of nodes.

    Of giants of one size, one is left out, or all. Nodes in no community are
    communities of one, where the number of nodes is given. 0 where nothing is left.
    """
    dist = size_distribution(member)
    s = dist.agg(
        F.sum(F.col("size") * F.col("n")).alias("nodes"), F.sum(F.col("size") * F.col("size") * F.col("n")).alias("squares"), F.max("size").alias("top"), F.max_by("n", "size").alias("tops")
    )
    gone = F.col("tops") if all_giants else F.lit(1)
    single = F.greatest(F.lit(n_nodes if n_nodes is not None else 0) - F.col("nodes"), F.lit(0))
    squares = F.col("squares") - gone * F.col("top") * F.col("top") + single
    rest = F.col("nodes") - gone * F.col("top") + single
    return s.select(F.when(rest > 0, squares / rest).otherwise(0.0).cast("double").alias("susceptibility"))


def chi(member: DataFrame) -> DataFrame:
    """One row, ``chi``: the squared sum of sizes by the sum of squared sizes, both without the giant."""
    d = sizes(member).agg(F.sum("size").alias("a"), F.sum(F.col("size") * F.col("size")).alias("b"), F.max("size").alias("top"))
    s = d.select((F.col("a") - F.col("top")).alias("a"), (F.col("b") - F.col("top") * F.col("top")).alias("b"))
    return s.select(F.when(F.col("b") > 0, F.col("a") * F.col("a") / F.col("b")).otherwise(0.0).alias("chi"))


def memberships(member: DataFrame) -> DataFrame:
    """``node, comms``: a node's communities."""
    return member.groupBy("node").agg(F.array_sort(F.collect_list("comm")).alias("comms"))


def restricted(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities of the given nodes alone."""
    return member.join(nodes.select("node").distinct(), "node", "left_semi")


def modularity(graph: Graph, member: DataFrame, variant: str = "standard") -> DataFrame:
    """One row, ``modularity`` of a partition of an undirected network.

    ``reference`` sums (2W w_ij - s_i s_j) / (2W)**2 over pairs i < j within
    communities; ``standard`` counts pairs both ways and nodes with themselves.
    No pairs are made: a community's product sum is its squared strength less
    the squares of its nodes.
    """
    side = lambda x: member.select(F.col("node").alias(x), F.col("comm").alias(f"c{x}"))
    inner = graph.edges.join(side("u"), "u").join(side("v"), "v").filter("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inner"))
    strength = graph.both_ways().groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("s"))
    per = member.join(strength, "node").groupBy("comm").agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    sums = per.agg(F.sum(F.col("s1") * F.col("s1")).alias("a"), F.sum("s2").alias("b"))
    total = graph.edges.agg((2 * F.sum("w")).alias("w2"))
    one = inner.crossJoin(sums).crossJoin(total)  # a row each
    if variant == "reference":
        q = F.col("inner") / F.col("w2") - (F.col("a") - F.col("b")) / 2 / F.col("w2") / F.col("w2")
    else:
        q = 2 * F.col("inner") / F.col("w2") - F.col("a") / F.col("w2") / F.col("w2")
    return one.select(q.alias("modularity"))


def average_weight_by_size(graph: Graph, member: DataFrame) -> DataFrame:
    """``size, weight``: the mean weight of edges within communities of each size."""
    side = lambda x: member.select(F.col("node").alias(x), F.col("comm").alias(f"c{x}"))
    inner = graph.edges.join(side("u"), "u").join(side("v"), "v").filter("cu = cv").select(F.col("cu").alias("comm"), "w")
    return inner.join(sizes(member), "comm").groupBy("size").agg(F.avg("w").alias("weight"))


def overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """``a, b, n``: nodes that a community of one and one of the other share."""
    a, b = first.select("node", F.col("comm").alias("a")), second.select("node", F.col("comm").alias("b"))
    return a.join(b, "node").groupBy("a", "b").agg(F.count("*").alias("n"))


def community_network(graph: Graph, member: DataFrame) -> DataFrame:
    """``a, b, w``: the weight of edges between communities."""
    side = lambda x, c: member.select(F.col("node").alias(x), F.col("comm").alias(c))
    rows = graph.edges.join(side("u", "cu"), "u").join(side("v", "cv"), "v").filter("cu <> cv")
    return rows.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.sum("w").alias("w"))


def partition_entropy(member: DataFrame) -> DataFrame:
    """One row, ``entropy`` of the sizes, in bits."""
    s = sizes(member)
    total = s.agg(F.sum("size").alias("n"))
    p = F.col("size") / F.col("n")
    return s.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row of two partitions of the same nodes: ``information`` they share, ``normalised`` 2I/(H+H'), ``distance`` 1 - I/max(H, H')."""
    n = first.agg(F.count("*").alias("n"))
    a, b = sizes(first).select(F.col("comm").alias("a"), F.col("size").alias("na")), sizes(second).select(F.col("comm").alias("b"), F.col("size").alias("nb"))
    rows = overlaps(first, second).withColumnRenamed("n", "nab").join(a, "a").join(b, "b").crossJoin(F.broadcast(n))
    mi = rows.agg(F.sum(F.col("nab") / F.col("n") * F.log2(F.col("nab") * F.col("n") / F.col("na") / F.col("nb"))).alias("information"))
    one = mi.crossJoin(partition_entropy(first).withColumnRenamed("entropy", "h1")).crossJoin(partition_entropy(second).withColumnRenamed("entropy", "h2"))
    top = F.greatest("h1", "h2")
    return one.select(
        "information",
        F.when(F.col("h1") + F.col("h2") > 0, 2 * F.col("information") / (F.col("h1") + F.col("h2"))).otherwise(1.0).alias("normalised"),
        F.when(top > 0, 1 - F.col("information") / top).otherwise(0.0).alias("distance"),
    )


def variation_of_information(first: DataFrame, second: DataFrame, n_nodes: int) -> DataFrame:
    """One row, ``variation`` of two covers: the mean, over communities both ways, of the least conditional entropy, by the entropy.

    A community of the other side counts only if what both have in common
    outweighs how they differ; where none does, the entropy itself stands.
    """
    total = F.lit(float(n_nodes))

    def h(x):
        p = x / total
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    def one_way(x: DataFrame, y: DataFrame) -> DataFrame:
        sx, sy = sizes(x).select(F.col("comm").alias("a"), F.col("size").alias("na")), sizes(y).select(F.col("comm").alias("b"), F.col("size").alias("nb"))
        rows = overlaps(x, y).join(sx, "a").join(sy, "b")
        n11, n10, n01 = F.col("n"), F.col("na") - F.col("n"), F.col("nb") - F.col("n")
        n00 = total - F.col("na") - F.col("nb") + F.col("n")
        same, differ = h(n11) + h(n00), h(n10) + h(n01)
        fits = F.when(same > differ, same + differ - h(F.col("nb")) - h(total - F.col("nb")))
        best = rows.groupBy("a").agg(F.min(fits).alias("best"))
        own = h(F.col("na")) + h(total - F.col("na"))
        scaled = F.when(own > 0, F.coalesce("best", own) / own).otherwise(0.0)
        return sx.join(best, "a", "left").agg(F.avg(scaled).alias("v"))

    return one_way(first, second).unionByName(one_way(second, first)).agg(F.avg("v").alias("variation"))


def tiling_imperfection(first: DataFrame, second: DataFrame) -> DataFrame:
    """``comm, imperfection, perfect``: the share of a community's nodes that lie in communities of the other which reach beyond it."""
    other = sizes(second).select(F.col("comm").alias("b"), F.col("size").alias("nb"))
    rows = overlaps(first, second).join(other, "b")
    torn = rows.groupBy("a").agg(F.sum(F.when(F.col("n") < F.col("nb"), F.col("n")).otherwise(0)).alias("torn"), F.max((F.col("n") == F.col("nb")).cast("int")).alias("whole"), F.count("*").alias("k"))
    mine = sizes(first)
    joined = mine.join(torn, F.col("comm") == F.col("a"), "left")
    return joined.select("comm", (F.coalesce("torn", F.lit(0)) / F.col("size")).alias("imperfection"), (F.coalesce(F.col("torn"), F.lit(0)) == 0).alias("perfect"))


def hierarchy(levels: list[DataFrame]) -> DataFrame:
    """``level, comm, parent``: of each community the one, a level up, that holds all its nodes; null at the top and where none does."""
    out = sizes(levels[0]).select(F.lit(0).alias("level"), "comm", F.lit(None).cast("long").alias("parent"))
    for k in range(1, len(levels)):
        s = sizes(levels[k])
        inside = overlaps(levels[k], levels[k - 1]).join(s, F.col("a") == F.col("comm")).filter("n = size")
        best = inside.groupBy("comm").agg(F.min("b").alias("parent"))
        out = out.unionByName(s.join(best, "comm", "left").select(F.lit(k).alias("level"), "comm", "parent"))
    return out



def tree_order(tree: DataFrame, levels: int) -> DataFrame:
    """``level, comm, parent, first, leaves`` of a :func:`hierarchy`: the place of a community's first leaf in the tree's order, and its leaves.

    Leaves are communities that hold none of the next level. Children follow
    their parent's order, then their number; what has no parent comes after the
    others of its level. A level is one running sum over ranges, however many
    children a community has.
    """
    tree = saved(tree, "tree")
    counted: list[DataFrame] = []
    for level in reversed(range(levels)):
        own = tree.filter(F.col("level") == level)
        if counted:
            below = counted[-1].filter("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.sum("leaves").alias("below"))
            own = own.join(below, F.col("comm") == F.col("of"), "left").drop("of")
        else:
            own = own.withColumn("below", F.lit(None).cast("long"))
        counted.append(saved(own.select("level", "comm", "parent", F.coalesce("below", F.lit(1)).cast("long").alias("leaves")), "leaves"))
    placed, out, end = None, None, 0
    for own in reversed(counted):
        if placed is not None:
            own = own.join(placed.select(F.col("comm").alias("of"), F.col("first").alias("from")), F.col("parent") == F.col("of"), "left").drop("of")
        else:
            own = own.withColumn("from", F.lit(None).cast("long"))
        run = running(own.withColumn("upto", F.col("leaves")), [F.col("from").asc_nulls_last(), F.col("comm")], sums=["upto"]).withColumn("before", F.col("upto") - F.col("leaves"))
        base = run.groupBy(F.col("parent").alias("of")).agg(F.min("before").alias("base"))
        run = run.join(base, F.col("parent").eqNullSafe(F.col("of")))
        first = F.coalesce("from", F.lit(end)) + F.col("before") - F.col("base")
        placed = saved(run.select("level", "comm", "parent", first.alias("first"), "leaves"), "tree-order")
        end = max(end, placed.agg(F.max(F.col("first") + F.col("leaves"))).first()[0] or 0)
        out = placed if out is None else out.unionByName(placed)
    return out


def thinned(tree: DataFrame, levels: int) -> DataFrame:
    """``level, comm, parent_level, parent`` of a :func:`hierarchy` without the communities that only pass on: of a run of them the first stays.

    Such a one has a parent and one child, as its parent has, or has two
    neighbours as a root. Pointers to what goes are doubled until all point to
    what stays.
    """
    here = tree.select("level", "comm", "parent")
    kids = here.filter("parent is not null").groupBy((F.col("level") - 1).alias("level"), F.col("parent").alias("comm")).agg(F.count("*").alias("kids"))
    deg = here.join(kids, ["level", "comm"], "left").select("level", "comm", "parent", (F.coalesce("kids", F.lit(0)) + F.col("parent").isNotNull().cast("int")).alias("deg"))
    up = deg.select((F.col("level") + 1).alias("level"), F.col("comm").alias("parent"), F.col("deg").alias("updeg"))
    rows = deg.join(up, ["level", "parent"], "left")
    gone = (F.col("deg") == 2) & F.col("parent").isNotNull() & F.coalesce(F.col("updeg") == 2, F.lit(False))
    at = F.when(F.col("parent").isNotNull(), F.struct((F.col("level") - 1).alias("level"), F.col("parent").alias("comm")))
    rows = saved(rows.select(F.struct("level", "comm").alias("me"), at.alias("to"), gone.alias("gone")), "thinning")
    reach = 1
    while reach < levels:
        next_ = rows.filter("gone").select(F.col("me").alias("via"), F.col("to").alias("beyond"))
        rows = saved(rows.join(next_, F.col("to") == F.col("via"), "left").select("me", F.coalesce("beyond", "to").alias("to"), "gone"), "thinning")
        reach *= 2
    return rows.filter("not gone").select("me.level", "me.comm", F.col("to.level").alias("parent_level"), F.col("to.comm").alias("parent"))
