"""Connected components, and the maximal subgraphs of events that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronomotif.operators.adjacency import next_events, within
from chronomotif.storage import released, saved


def connected(edges: DataFrame) -> DataFrame:
    """From ``u, v``: ``node, comp`` for every node that has an edge; ``comp`` is its component's least node.

    Alternating stars: nodes tie their larger neighbours to the least one, then
    their smaller ones. Chains of any length fold up in few rounds, and no
    node's neighbours are gathered in one place.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    mark = before = None
    while True:
        # How many links there are, and a sum of their hashes, come with the writing.
        seen = Observation()
        links = saved(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")), "components")
        if before is not None:
            released(before)
        before, now = links, seen.get
        if now == mark or not now["n"]:
            break
        mark = now
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(links.select("v", "v").distinct())


def maximal_subgraphs(events: DataFrame, tw: int, adjacent: DataFrame | None = None) -> DataFrame:
    """``event_id, comp``: events joined by gaps within ``tw``, under the least id; lone events have their own."""
    adjacent = within(next_events(events) if adjacent is None else adjacent, tw)
    comp = connected(adjacent.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "of")
    return events.join(comp, F.col("event_id") == F.col("of"), "left").select("event_id", F.coalesce("comp", "event_id").alias("comp"))
