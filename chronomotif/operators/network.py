"""Aggregate networks of events, and the space of places where motifs can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.canonical import basic, canonical, key, relabelled
from chronomotif.operators.subgraphs import nodes_of
from chronomotif.operators.triples import triple_totals
from chronomotif.storage import saved


def aggregate_net(events: DataFrame) -> DataFrame:
    """``src, dst, w``: events on each directed edge."""
    return events.groupBy("src", "dst").agg(F.count("*").alias("w"))


def typed_net(events: DataFrame) -> DataFrame:
    """``src, dst, etype, w``: events of each type on each directed edge."""
    return events.groupBy("src", "dst", "etype").agg(F.count("*").alias("w"))


def event_types(events: DataFrame) -> DataFrame:
    return events.select("etype").distinct()


def weight_distribution(net: DataFrame) -> DataFrame:
    """``w, n``: edges of each weight."""
    return net.groupBy("w").agg(F.count("*").alias("n"))


def edge_sequences(tnet: DataFrame, max_len: int, mixed_types: bool = False) -> DataFrame:
    """``edges, ws``: ordered sequences of up to ``max_len`` typed edges, each new one at a node of those before.

    An edge can come again. All edges of a sequence have one type, unless
    ``mixed_types``. ``ws`` are the edges' weights. Where ``tnet`` has the types
    of its nodes (:func:`with_node_types`), ``ts`` are those of all ends.
    """
    edge = F.struct("src", "dst", "etype")
    typed = ["ts"] if "st" in tnet.columns else []
    more = [F.array("st", "dt").alias("ts")] if typed else []
    level = tnet.select(F.array(edge).alias("edges"), F.array("w").alias("ws"), *more)
    out = level
    incident = tnet.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), F.col("etype").alias("kind"), edge.alias("edge"), "w", *(m.alias("edge_ts") for m in more))
    for _ in range(max_len - 1):
        ends = level.select("edges", "ws", *typed, F.col("edges")[0]["etype"].alias("kind"), F.explode(nodes_of()).alias("node"))
        if mixed_types:
            ends = ends.drop("kind")
        grown = ends.join(incident, ["node"] if mixed_types else ["node", "kind"])
        # An edge with both nodes in the sequence is met at either: kept at the first.
        first = F.array_min(F.filter(F.array(F.array_position(nodes_of(), F.col("edge")["src"]), F.array_position(nodes_of(), F.col("edge")["dst"])), lambda k: k > 0))
        grown = grown.filter(F.array_position(nodes_of(), F.col("node")) == first)
        level = grown.select(
            F.concat("edges", F.array("edge")).alias("edges"), F.concat("ws", F.array("w")).alias("ws"), *(F.concat("ts", "edge_ts").alias("ts") for _ in typed)
        )
        out = out.unionByName(level)
    return out


def with_motifs(places: DataFrame, node_types: DataFrame | None, hypothesis: int = 0) -> DataFrame:
    """Places with ``motif``, their typed key, and ``ref_key``, the key under which references are pooled.

    The hypothesis tells what is forgotten there: 0 the types of nodes, 1 those
    of events, 2 both. Nodes without a type have 0. Places that carry the types
    of their ends, ``ts``, need no table of them.
    """
    if "ts" in places.columns:
        ends = F.flatten(F.transform("edges", lambda e: F.array(e["src"], e["dst"])))
        typed = places.withColumn("ntypes", F.transform(nodes_of(), lambda n: F.get("ts", (F.array_position(ends, n) - 1).cast("int")))).drop("ts")
    elif node_types is None:
        typed = places.withColumn("ntypes", F.transform(nodes_of(), lambda n: F.lit(0)))
    else:
        # One row for each place and node, then back: the table of types is joined, never sent whole.
        numbered = places.select("*", F.posexplode(nodes_of()).alias("at", "node")).join(node_types, "node", "left")
        typed = numbered.groupBy(*places.columns).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("ntype", F.lit(0)).alias("t")))), lambda x: x["t"]).alias("ntypes")
        )
    return keyed(typed, relabelled(), hypothesis)


def keyed(rows: DataFrame, events: Column, hypothesis: int) -> DataFrame:
    """Rows with ``motif`` and ``ref_key`` from their ``ntypes`` and events."""
    kept_nodes, kept_events = basic(F.col("ntypes"), events, nodes=hypothesis in (0, 2), kinds=hypothesis in (1, 2))
    return rows.withColumn("motif", key(F.col("ntypes"), events)).withColumn("ref_key", key(kept_nodes, kept_events))


def with_node_types(tnet: DataFrame, node_types: DataFrame | None) -> DataFrame:
    """Typed edges with the types of their ends, ``st, dt``; 0 where there is none."""
    if node_types is None:
        return tnet.withColumn("st", F.lit(0)).withColumn("dt", F.lit(0))
    a, b = (node_types.select(F.col("node").alias(x), F.col("ntype").alias(t)) for x, t in (("src", "st"), ("dst", "dt")))
    return tnet.join(a, "src", "left").join(b, "dst", "left").select(*tnet.columns, *(F.coalesce(t, F.lit(0)).alias(t) for t in ("st", "dt")))


def place_totals(bnet: DataFrame, max_len: int, mixed_types: bool = False) -> DataFrame:
    """``ntypes, events, bins, n``: how many places of up to three edges look alike, without making them.

    ``bnet`` has ``src, dst, etype, bin, st, dt``. Pairs of edges at a node are
    counted from how many edges of each kind it has; pairs between the same two
    nodes, which are as many as edges at most times types, are counted by
    themselves and taken from those.
    """
    event = lambda i, j, c: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).alias("c"))
    one = bnet.groupBy("etype", "bin", "st", "dt").agg(F.count("*").alias("n"))
    one = one.select(F.array("st", "dt").alias("ntypes"), F.array(event(0, 1, "etype")).alias("events"), F.array("bin").alias("bins"), "n")
    if max_len == 1:
        return one
    if max_len > 3:
        raise ValueError("places of more than three edges are made, not counted")
    if max_len == 3:
        return place_totals(bnet, 2, mixed_types).unionByName(triple_totals(bnet, mixed_types))
    kind = ["c"] if not mixed_types else []
    named = bnet.withColumnRenamed("etype", "c")
    out = named.groupBy(F.col("src").alias("node"), F.col("st").alias("centre"), "c", "bin", F.col("dt").alias("far")).agg(F.count("*").alias("n"))
    into = named.groupBy(F.col("dst").alias("node"), F.col("dt").alias("centre"), "c", "bin", F.col("st").alias("far")).agg(F.count("*").alias("n"))

    def at_node(x: DataFrame, y: DataFrame) -> DataFrame:
        first = x.select("node", "centre", *kind, F.col("c").alias("c1"), F.col("bin").alias("b1"), F.col("far").alias("f1"), F.col("n").alias("n1"))
        second = y.select("node", *kind, F.col("c").alias("c2"), F.col("bin").alias("b2"), F.col("far").alias("f2"), F.col("n").alias("n2"))
        both = first.join(second, ["node", *kind])
        return both.groupBy("centre", "c1", "b1", "f1", "c2", "b2", "f2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))

    def between(turned: bool) -> DataFrame:
        other = named.select(F.col("dst" if turned else "src").alias("src"), F.col("src" if turned else "dst").alias("dst"), *kind, F.col("c").alias("c2"), F.col("bin").alias("b2"))
        both = named.withColumn("c1", F.col("c")).withColumnRenamed("bin", "b1").join(other, ["src", "dst", *kind])
        return both.groupBy("c1", "b1", "c2", "b2", "st", "dt").agg(F.count("*").alias("n"))

    def row(df: DataFrame, types: tuple[str, ...], second: tuple[int, int], sign: int = 1) -> DataFrame:
        return df.select(F.array(*types).alias("ntypes"), F.array(event(0, 1, "c1"), event(*second, "c2")).alias("events"), F.array("b1", "b2").alias("bins"), (sign * F.col("n")).alias("n"))

    same, back = saved(between(False), "same-ends"), saved(between(True), "turned-ends")
    parts = [
        one,
        row(same, ("st", "dt"), (0, 1)), row(back, ("st", "dt"), (1, 0)),
        row(at_node(out, out), ("centre", "f1", "f2"), (0, 2)), row(same, ("st", "dt", "dt"), (0, 2), -1),
        row(at_node(into, into), ("f1", "centre", "f2"), (2, 1)), row(same, ("st", "dt", "st"), (2, 1), -1),
        row(at_node(into, out), ("f1", "centre", "f2"), (1, 2)), row(back, ("st", "dt", "st"), (1, 2), -1),
        row(at_node(out, into), ("centre", "f1", "f2"), (2, 0)), row(back, ("st", "dt", "dt"), (2, 0), -1),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("ntypes", "events", "bins").agg(F.sum("n").alias("n")).filter("n > 0")


def placed(counts: DataFrame, bnet: DataFrame, max_len: int = 2) -> DataFrame:
    """Places of up to ``max_len`` edges that are found (``edges, cnt``), with ``bins`` and ``ts``.

    Those with an edge outside all bins are left out, and those in whose order
    an edge meets none before it.
    """
    side = lambda k: bnet.select(F.struct("src", "dst", "etype").alias(f"e{k}"), F.struct("bin", "st", "dt").alias(f"x{k}"))
    meets = F.forall(F.sequence(F.lit(1), F.size("edges")), lambda k: (k == 1) | F.exists(F.slice("edges", 1, k - 1), lambda e: _touches(e, F.get("edges", k - 1))))
    rows = counts.filter(meets)
    for k in range(max_len):
        rows = rows.withColumn(f"e{k}", F.get("edges", F.lit(k))).join(side(k), f"e{k}", "left").filter(f"e{k} is null or x{k} is not null")
    seen = F.slice(F.array(*(f"x{k}" for k in range(max_len))), 1, F.size("edges"))
    return rows.select("edges", "cnt", F.transform(seen, lambda x: x["bin"]).alias("bins"), F.flatten(F.transform(seen, lambda x: F.array(x["st"], x["dt"]))).alias("ts"))


def _touches(a: Column, b: Column) -> Column:
    return (a["src"] == b["src"]) | (a["src"] == b["dst"]) | (a["dst"] == b["src"]) | (a["dst"] == b["dst"])


def untyped(places: DataFrame) -> DataFrame:
    """Places with ``motif``, the key without types, and ``static``, the one without order too."""
    ntypes, events = basic(F.transform(nodes_of(), lambda n: F.lit(0)), relabelled())
    return places.withColumn("motif", key(ntypes, events)).withColumn("static", canonical(ntypes, events, "multigraph"))


def static_counts(places: DataFrame) -> DataFrame:
    """``motif, count``: sets by the key without types and order; the key is searched for once for each ordered one, not for each place."""
    ntypes, events = basic(F.transform(nodes_of(), lambda n: F.lit(0)), relabelled())
    ordered = places.groupBy(ntypes.alias("ntypes"), events.alias("events")).agg(F.sum("cnt").alias("cnt"))
    return ordered.groupBy(canonical(F.col("ntypes"), F.col("events"), "multigraph").alias("motif")).agg(F.sum("cnt").alias("count"))


def sequence_totals(tnet: DataFrame) -> DataFrame:
    """``pattern, n``: sequences of two edges of one type by pattern, without making them.

    Counted from the nodes' degrees: pairs at a node, less the pairs that are
    one edge or two opposite ones.
    """
    loops = tnet.groupBy("etype").agg(F.count("*").alias("edges"))
    opposite = tnet.select("etype", F.col("src").alias("x"), F.col("dst").alias("y"))
    twice = tnet.join(opposite, (tnet["etype"] == opposite["etype"]) & (F.col("src") == F.col("y")) & (F.col("dst") == F.col("x")), "left_semi").agg(F.count("*").alias("n"))
    out_d = tnet.groupBy("etype", F.col("src").alias("node")).agg(F.count("*").alias("o"))
    in_d = tnet.groupBy("etype", F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    deg = out_d.join(in_d, ["etype", "node"], "full").select(F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i"))
    sums = deg.agg(F.sum(F.expr("o * (o - 1)")).alias("out_star"), F.sum(F.expr("i * (i - 1)")).alias("in_star"), F.sum(F.expr("o * i")).alias("through"))
    one = loops.agg(F.sum("edges").alias("repeat")).crossJoin(sums).crossJoin(twice)  # a row each
    rows = F.array(
        F.struct(F.lit("0>1 0>1").alias("pattern"), F.col("repeat").cast("long").alias("n")),
        F.struct(F.lit("0>1 1>0").alias("pattern"), F.col("n").cast("long").alias("n")),
        F.struct(F.lit("0>1 0>2").alias("pattern"), F.col("out_star").cast("long").alias("n")),
        F.struct(F.lit("0>1 2>1").alias("pattern"), F.col("in_star").cast("long").alias("n")),
        F.struct(F.lit("0>1 1>2").alias("pattern"), (F.col("through") - F.col("n")).cast("long").alias("n")),
        F.struct(F.lit("0>1 2>0").alias("pattern"), (F.col("through") - F.col("n")).cast("long").alias("n")),
    )
    return one.select(F.inline(rows)).filter("n > 0")
