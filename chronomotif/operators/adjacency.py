"""Which events follow each other: node-event index, next and previous events, time gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.ordering import in_order


def node_events(events: DataFrame) -> DataFrame:
    """Two rows an event, one for each of its nodes: ``node`` and the event's columns."""
    return events.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("node"), *events.columns)


def node_index(events: DataFrame) -> DataFrame:
    """``node, event_id, place, before, after``: each node's events in order, with their neighbours there."""
    rows = in_order(node_events(events).select("node", "event_id"), ["node"], "event_id", ["event_id"], ["event_id"], "place")
    return rows.select("node", "event_id", F.col("place").cast("int").alias("place"), F.col("prev_event_id").alias("before"), F.col("next_event_id").alias("after"))


def next_events(events: DataFrame) -> DataFrame:
    """``a, b, gap``: ``b`` is an immediate next event of ``a``.

    It is the next one of a node of both. Where it is so for one node alone, it
    is left out if both events are on the same pair of nodes: then another
    event came between at the other node. The gap is from the end of ``a`` to
    the start of ``b`` and negative where they overlap.
    """
    rows = in_order(node_events(events).select("node", "event_id", "start", "end", "src", "dst"), ["node"], "event_id", ["event_id", "start", "src", "dst"])
    pairs = rows.withColumnsRenamed({f"next_{c}": f"b_{c}" for c in ("event_id", "start", "src", "dst")}).filter("b_event_id is not null")
    same = (F.least("src", "dst") == F.least("b_src", "b_dst")) & (F.greatest("src", "dst") == F.greatest("b_src", "b_dst"))
    grouped = pairs.groupBy(F.col("event_id").alias("a"), F.col("b_event_id").alias("b")).agg(
        F.count("*").alias("n"), F.first(same).alias("same"), F.first(F.col("b_start") - F.col("end")).alias("gap")
    )
    return grouped.filter((F.col("n") == 2) | ~F.col("same")).select("a", "b", "gap")


def previous_events(events: DataFrame) -> DataFrame:
    """``a, b, gap``: ``b`` is an immediate previous event of ``a``; the mirror image of :func:`next_events`."""
    return next_events(events).select(F.col("b").alias("a"), F.col("a").alias("b"), "gap")


def within(adjacent: DataFrame, tw: int) -> DataFrame:
    """Pairs whose gap is from 0 to ``tw``."""
    return adjacent.filter(F.col("gap").between(0, tw))


def in_window(events: DataFrame, time_gap: int = 0) -> DataFrame:
    """Events that start at least ``time_gap`` after the first start and before the last, by order of ids."""
    if not time_gap:
        return events
    ends = events.agg(F.min_by("start", "event_id").alias("lo"), F.max_by("start", "event_id").alias("hi"))
    # One row.
    return events.join(F.broadcast(ends), F.col("start").between(F.col("lo") + time_gap, F.col("hi") - time_gap)).select(events.columns)
