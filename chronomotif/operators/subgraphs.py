"""Connected sets of events, their validity, and counts of the places where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.ordering import in_order
from chronomotif.operators.adjacency import in_window, node_events
from chronomotif.storage import saved


def connected_sets(roots: DataFrame, adjacent: DataFrame, max_size: int | None) -> DataFrame:
    """``root, ids, gap``: all sets of up to ``max_size`` events (None: of any size) connected by ``adjacent``, each once, by its least id.

    ``roots`` has ``event_id``, ``adjacent`` has ``a, b, gap`` within the time
    window. Every way to a set keeps its root, so sets are told apart within
    the partition of the root. ``gap`` is the least bound that connects the set.
    """
    both = adjacent.select("a", "b", "gap").unionAll(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    level = roots.select(F.col("event_id").alias("root"), F.array("event_id").alias("ids"), F.lit(0).cast("long").alias("gap"))
    out, size = level, 1
    while max_size is None or size < max_size:
        open_ends = level.select("root", "ids", "gap", F.explode("ids").alias("a")).withColumnRenamed("gap", "before")
        grown = open_ends.join(both, "a").filter((F.col("b") > F.col("root")) & ~F.array_contains("ids", F.col("b")))
        level = grown.groupBy("root", F.array_sort(F.concat("ids", F.array("b"))).alias("ids")).agg(F.min(F.greatest("before", "gap")).alias("gap"))
        size += 1
        if max_size is None:
            level = saved(level, "sets-of-one-size")
            if not level.limit(1).count():
                break
        out = out.unionByName(level)
    return out


def ranked_nodes(events: DataFrame, comp: DataFrame) -> DataFrame:
    """``event_id, node, place``: the event's place among the node's events of its maximal subgraph."""
    rows = node_events(events).select("node", "event_id").join(comp, "event_id")
    return in_order(rows, ["node", "comp"], "event_id", place="place").select("event_id", "node", F.col("place").cast("int").alias("place"))


def _consecutive(at: Column) -> Column:
    """Whether places (``node, place``) of a set's events have no gaps at any node."""
    nodes = F.array_distinct(F.transform(at, lambda x: x["node"]))
    here = lambda n: F.transform(F.filter(at, lambda x: x["node"] == n), lambda x: x["place"])
    return F.forall(nodes, lambda n: F.array_max(here(n)) - F.array_min(here(n)) + 1 == F.size(here(n)))


def described(sets: DataFrame, events: DataFrame, places: DataFrame) -> DataFrame:
    """Sets with their ``edges`` in order of ids and ``valid``: at every node the events are consecutive there."""
    at = places.groupBy("event_id").agg(F.collect_list(F.struct("node", "place")).alias("at"))
    one = events.select("event_id", F.struct("src", "dst", "etype").alias("edge")).join(at, "event_id")
    rows = sets.select("root", "ids", "gap", F.explode("ids").alias("event_id")).join(one, "event_id")
    full = rows.groupBy("root", "ids", "gap").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "edge"))), lambda x: x["edge"]).alias("edges"), F.flatten(F.collect_list("at")).alias("at")
    )
    return full.select("root", "ids", "gap", "edges", _consecutive(F.col("at")).alias("valid"))


def near_sets(events: DataFrame, adjacent: DataFrame, comp: DataFrame, max_size: int, time_gap: int = 0) -> DataFrame:
    """The valid sets of up to three events, read off each event's neighbours: no set is grown, gathered or told apart from another.

    An event has two next and two previous ones at most, and carries its places
    at its nodes. A set of three lies around an event with two neighbours; where
    those are neighbours too, around its least one alone.
    """
    at = ranked_nodes(events, comp).groupBy("event_id").agg(F.collect_list(F.struct("node", "place")).alias("at"))
    first = in_window(events, time_gap).select("event_id", F.lit(True).alias("first"))
    own = events.select("event_id", F.struct("src", "dst", "etype").alias("edge")).join(at, "event_id").join(first, "event_id", "left")
    both = adjacent.select("a", "b", "gap").unionAll(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    links = both.groupBy(F.col("a").alias("event_id")).agg(F.collect_list(F.struct("b", "gap")).alias("links"))
    own = own.join(links, "event_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<b:bigint,gap:bigint>>")))
    own = saved(own.select(F.struct("event_id", "edge", "at", F.coalesce("first", F.lit(False)).alias("first")).alias("e"), "links"), "events-with-places")
    near = both.join(own.select(F.col("e.event_id").alias("b"), "e", "links"), "b").groupBy(F.col("a").alias("x")).agg(F.collect_list(F.struct("e", "gap", "links")).alias("others"))
    rows = own.join(near, F.col("e.event_id") == F.col("x"), "left").select("e", F.coalesce("others", F.array().cast(near.schema["others"].dataType)).alias("others"))

    def three(o: Column, p: Column) -> Column:
        closing = F.get(F.filter(o["links"], lambda x: x["b"] == p["e"]["event_id"]), F.lit(0))["gap"]
        wide = F.greatest(o["gap"], p["gap"])
        # Of three gaps the middle one connects.
        middle = F.greatest(F.least(o["gap"], p["gap"]), F.least(wide, closing))
        once = closing.isNull() | (F.col("e.event_id") < F.least(o["e"]["event_id"], p["e"]["event_id"]))
        return F.when(once, F.struct(F.array("e", o["e"], p["e"]).alias("of"), F.when(closing.isNull(), wide).otherwise(middle).alias("gap")))

    found = [F.array(F.struct(F.array("e").alias("of"), F.lit(0).cast("long").alias("gap")))]
    if max_size > 1:
        later = F.filter("others", lambda o: o["e"]["event_id"] > F.col("e.event_id"))
        found.append(F.transform(later, lambda o: F.struct(F.array("e", o["e"]).alias("of"), o["gap"].alias("gap"))))
    if max_size > 2:
        found.append(F.flatten(F.transform("others", lambda o, i: F.transform(F.filter("others", lambda p, j: j > i), lambda p: three(o, p)))))
    sets = rows.select(F.explode(F.concat(*found)).alias("s")).filter("s is not null").select(F.array_sort("s.of").alias("of"), "s.gap")
    valid = sets.filter(F.col("of")[0]["first"] & _consecutive(F.flatten(F.transform("of", lambda x: x["at"]))))
    return valid.select(F.col("of")[0]["event_id"].alias("root"), F.transform("of", lambda x: x["event_id"]).alias("ids"), "gap", F.transform("of", lambda x: x["edge"]).alias("edges"))


def valid_sets(events: DataFrame, adjacent: DataFrame, comp: DataFrame, max_size: int | None, time_gap: int = 0) -> DataFrame:
    """Described sets, the roots from within the time window, that are valid."""
    if max_size in (1, 2, 3):
        return near_sets(events, adjacent, comp, max_size, time_gap)
    sets = connected_sets(in_window(events, time_gap), adjacent, max_size)
    return described(sets, events, ranked_nodes(events, comp)).filter("valid").drop("valid")


#: Ids that one group of a maximal subgraph's events spans at most before the groups are put together.
CHUNK = 4_096


def maximal_sets(events: DataFrame, comp: DataFrame, max_size: int | None = None, time_gap: int = 0) -> DataFrame:
    """The events of every maximal subgraph, within the time window, as one set; those of up to ``max_size`` if it is given.

    A set's events never carry the set: its validity is found node by node, and
    its events are gathered by stretches of ids, which are then put in order.
    """
    rows = in_window(events, time_gap).filter("src <> dst").select("event_id", F.struct("src", "dst", "etype").alias("edge")).join(comp, "event_id")
    if max_size:
        rows = rows.join(rows.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") <= max_size).select("comp"), "comp", "left_semi")
    if time_gap:  # else every event of a maximal subgraph is there, and no place is missing
        at = ranked_nodes(events, comp).join(rows.select("event_id", "comp"), "event_id")
        gaps = at.groupBy("comp", "node").agg((F.max("place") - F.min("place") + 1 > F.count("*")).alias("gaps")).filter("gaps").select("comp")
        rows = rows.join(gaps, "comp", "left_anti")
    chunk = F.floor(F.col("event_id") / CHUNK).alias("chunk")
    parts = rows.groupBy("comp", chunk).agg(F.array_sort(F.collect_list(F.struct("event_id", "edge"))).alias("of"))
    parts = parts.select("comp", F.struct("chunk", F.col("of.event_id").alias("x")).alias("ids"), F.struct("chunk", F.col("of.edge").alias("x")).alias("edges"))
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["x"])).alias(c)
    return parts.groupBy(F.col("comp").alias("root")).agg(whole("ids"), whole("edges")).select("root", "ids", F.lit(None).cast("long").alias("gap"), "edges")


def ids_text(ids: str = "ids") -> Column:
    """An array of ids as text, a stretch at a time: a large set's ids are never all there as texts."""
    text = lambda x: F.array_join(F.transform(x, lambda k: k.cast("string")), ",")
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / CHUNK).cast("int")), lambda k: text(F.slice(ids, k * CHUNK + 1, F.lit(CHUNK))))
    return F.when(F.size(ids) <= CHUNK, text(F.col(ids))).otherwise(F.array_join(stretches, ","))


def nodes_of(edges: str = "edges"):
    """The distinct nodes of a sequence of edges, in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["src"], e["dst"]))))


def undirected_edges_of(edges: str = "edges"):
    """The distinct edges of a sequence without direction, as ``src <= dst``."""
    flat = lambda e: F.struct(F.least(e["src"], e["dst"]).alias("src"), F.greatest(e["src"], e["dst"]).alias("dst"), e["etype"].alias("etype"))
    return F.array_distinct(F.transform(edges, flat))


def location_counts(sets: DataFrame) -> DataFrame:
    """``edges, cnt``: how many sets are at an ordered sequence of typed edges."""
    return sets.groupBy("edges").agg(F.count("*").alias("cnt"))
