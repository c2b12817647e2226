"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronomotif.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """``u, v`` for every node that has a smaller one in its component: ``v`` is the smallest.

    ``links`` has integer ``u, v`` in any order. A large star ties the larger
    neighbours of a node to the smallest one, a small star does so for the
    smaller ones; the links become stars after few rounds, whatever the shape.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    mark = before = None
    while True:
        # How many links there are, and a sum of their hashes, come with the writing.
        seen = Observation()
        links = materialize(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")), "links")
        if before is not None:
            release(before)
        before = links
        now = seen.get
        if now == mark or not now["n"]:
            return links
        mark = now
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
