"""The null model: places are alike if they have the same pattern and edge weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomotif.operators.network import weight_distribution


def omit_heaviest(net: DataFrame, share: float) -> DataFrame:
    """``w, n`` of the weights that stay when the heaviest go, whole weights at a time.

    Weights go until at least ``floor(share * edges)`` edges have gone.
    """
    if not 0 <= share < 1:
        raise ValueError("the share of edges to leave out must be at least 0 and below 1")
    dist = weight_distribution(net)
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    # One row for each distinct weight.
    return dist.withColumn("above", above).withColumn("gone", F.floor(F.lit(share) * total)).filter("above >= gone").select("w", "n")


def bin_limits(weights: DataFrame) -> DataFrame:
    """``bin, lo, hi``: a bin for each distinct weight, the last ending one above it."""
    w = Window.orderBy("w")
    return weights.select((F.row_number().over(w) - 1).alias("bin"), F.col("w").alias("lo"), F.coalesce(F.lead("w").over(w), F.col("w") + 1).alias("hi"))


def binned_by_count(weights: DataFrame, least: int) -> DataFrame:
    """``bin, lo, hi``: neighbouring weights together until a bin has at least ``least`` edges, as far as running sums tell."""
    w = Window.orderBy("w")
    run = weights.withColumn("bin", F.floor((F.sum("n").over(w) - F.col("n")) / F.lit(least)))
    bins = run.groupBy("bin").agg(F.min("w").alias("lo"), F.max("w").alias("top"))
    v = Window.orderBy("lo")
    return bins.select((F.row_number().over(v) - 1).alias("bin"), "lo", F.coalesce(F.lead("lo").over(v), F.col("top") + 1).alias("hi"))


def with_bins(places: DataFrame, limits: DataFrame) -> DataFrame:
    """Places with ``bins``, of each weight; those with a weight outside all bins are left out."""
    # Limits are as many as there are distinct weights: one row holds them, as the largest bin that begins at most at w.
    edges = limits.agg(F.array_sort(F.collect_list("lo")).alias("los"), F.max("hi").alias("top"))
    rows = places.crossJoin(F.broadcast(edges))
    inside = F.forall("ws", lambda x: (x >= F.col("los")[0]) & (x < F.col("top")))
    index = lambda x: F.size(F.filter("los", lambda lo: lo <= x)) - 1
    return rows.filter(inside).withColumn("bins", F.transform("ws", index)).drop("los", "top")


def cells(places: DataFrame) -> DataFrame:
    """``ref_key, bins, value, n``: how many places of a cell have a count. ``places`` has ``ref_key, bins, cnt``."""
    return places.groupBy("ref_key", "bins", F.col("cnt").alias("value")).agg(F.count("*").alias("n"))


def cell_moments(cells_: DataFrame) -> DataFrame:
    """``ref_key, bins, total, mean, var`` of a cell's counts, the variance being the population's."""
    sums = cells_.groupBy("ref_key", "bins").agg(F.sum("n").alias("total"), F.sum(F.col("value") * F.col("n")).alias("s1"), F.sum(F.col("value") * F.col("value") * F.col("n")).alias("s2"))
    mean = F.col("s1") / F.col("total")
    return sums.select("ref_key", "bins", "total", mean.alias("mean"), F.greatest(F.col("s2") / F.col("total") - mean * mean, F.lit(0.0)).alias("var"))


def summed_cells(totals: DataFrame, hits: DataFrame) -> DataFrame:
    """As :func:`cells`, from how many places there are (``ref_key, bins, n``) and those that are found (``ref_key, bins, cnt``): the others have none."""
    found = hits.groupBy("ref_key", "bins", F.col("cnt").alias("value")).agg(F.count("*").alias("n"))
    gone = found.groupBy("ref_key", "bins").agg(F.sum("n").alias("found"))
    empty = totals.groupBy("ref_key", "bins").agg(F.sum("n").alias("n")).join(gone, ["ref_key", "bins"], "left")
    empty = empty.select("ref_key", "bins", F.lit(0).cast("long").alias("value"), (F.col("n") - F.coalesce("found", F.lit(0))).alias("n"))
    return found.unionByName(empty.filter("n > 0"))


def alike_places(places: DataFrame) -> DataFrame:
    """``ref_key, bins, motif, places, hit`` of all places (``ref_key, bins, motif, cnt``)."""
    return places.groupBy("ref_key", "bins", "motif").agg(F.count("*").alias("places"), F.count_if(F.col("cnt") > 0).alias("hit"))


def alike_summed(totals: DataFrame, hits: DataFrame) -> DataFrame:
    """The same from totals (``ref_key, bins, motif, n``) and the places that are found."""
    by = ["ref_key", "bins", "motif"]
    found = hits.groupBy(*by).agg(F.count("*").alias("hit"))
    return totals.groupBy(*by).agg(F.sum("n").alias("places")).join(found, by, "left").select(*by, "places", F.coalesce("hit", F.lit(0)).alias("hit"))


def expectation(alike: DataFrame, moments: DataFrame) -> DataFrame:
    """``motif, ref_avg, ref_std, n_loc_tot, n_loc``: the exact mean and deviation of a reference's count, from :func:`alike_places` or :func:`alike_summed`."""
    joined = alike.join(moments, ["ref_key", "bins"])
    return joined.groupBy("motif").agg(
        F.sum(F.col("places") * F.col("mean")).alias("ref_avg"),
        F.sqrt(F.sum(F.col("places") * F.col("var"))).alias("ref_std"),
        F.sum("places").alias("n_loc_tot"),
        F.sum("hit").alias("n_loc"),
    )


def uniform(seed: int, *parts):
    """A number from 0 to 1 from a seed and columns, the same in any engine that has md5."""
    text = F.concat_ws("#", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sampled(places: DataFrame, cells_: DataFrame, references: int, seed: int) -> DataFrame:
    """``motif, ref, total, hit``: references in which every place draws a count from its cell.

    A cell's distinct counts are few; they are held as an array with their
    running shares, in which each draw is looked up.
    """
    w = Window.partitionBy("ref_key", "bins").orderBy("value")
    shares = cells_.withColumn("upto", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("ref_key", "bins")))
    table = shares.groupBy("ref_key", "bins").agg(F.array_sort(F.collect_list(F.struct("upto", "value"))).alias("draws"))
    name = F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["src"].cast("string"), e["dst"].cast("string"), e["etype"].cast("string"))), " ")
    rows = places.join(table, ["ref_key", "bins"]).withColumn("ref", F.explode(F.sequence(F.lit(1), F.lit(references))))
    rows = rows.withColumn("u", uniform(seed, F.col("ref"), name))
    value = F.coalesce(F.get(F.filter("draws", lambda d: d["upto"] > F.col("u")), F.lit(0))["value"], F.element_at("draws", -1)["value"])
    drawn = rows.select("motif", "ref", value.alias("value"))
    return drawn.groupBy("motif", "ref").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("hit"))


#: Motifs whose references a worker sums before it hands them on.
MOTIFS_HELD = 64


def drawn_by_cell(alike: DataFrame, cells_: DataFrame, references: int, seed: int) -> DataFrame:
    """``motif, ref, total, hit``: references as :func:`sampled` draws them, but for all places of a motif in a cell at once.

    Places that draw a count each from their cell's histogram draw together how
    often each count comes: a multinomial. So a row is a motif in a cell,
    however many places it has there, and its references come from a generator
    whose seed is the row's own, whatever task it is in. ``alike`` has
    ``ref_key, bins, motif, places``.
    """
    by = ["ref_key", "bins"]
    table = cells_.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("histogram"))
    name = F.concat_ws("#", F.lit(str(seed)), "ref_key", F.array_join(F.transform("bins", lambda b: b.cast("string")), ","), "motif")
    # Counts other than none come first: what is left over is no count.
    ordered = F.concat(F.filter("histogram", lambda h: h["value"] > 0), F.filter("histogram", lambda h: h["value"] == 0))
    rows = alike.join(table, by).select("motif", "places", name.alias("name"), F.transform(ordered, lambda h: h["value"]).alias("values"), F.transform(ordered, lambda h: h["n"]).alias("ns"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(held, pa.string()), *(pa.array([sums[k] for sums in held.values()], pa.list_(pa.int64())) for k in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["motif", "totals", "hits"])

        for batch in batches:
            for motif, places, name, values, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                generator = np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256(name.encode()).digest()[:16], "little")))
                shares, values = np.array(ns, float) / sum(ns), np.array(values, np.int64)
                times = generator.multinomial(places, shares, size=references)
                sums = held.setdefault(motif, np.zeros((2, references), np.int64))
                sums[0] += times @ values
                sums[1] += times[:, values > 0].sum(1)
                if len(held) > MOTIFS_HELD:
                    yield flushed()
        yield flushed()

    parts = rows.mapInArrow(draw, "motif string, totals array<long>, hits array<long>")
    each = parts.select("motif", F.posexplode(F.arrays_zip("totals", "hits")).alias("at", "x"))
    return each.groupBy("motif", (F.col("at") + 1).alias("ref")).agg(F.sum("x.totals").alias("total"), F.sum("x.hits").alias("hit"))


def statistics(counts: DataFrame, samples: DataFrame, references: int) -> DataFrame:
    """``motif`` and the reference columns of a report, from counts (``motif, count``) and sampled references."""
    both = counts.join(samples, "motif", "left")
    return both.groupBy("motif").agg(
        (F.sum("total") / references).alias("ref_avg"),
        F.stddev_pop("total").alias("ref_std"),
        F.lit(references).alias("n_ref"),
        F.count_if(F.col("count") < F.col("total")).cast("int").alias("n_lt_ref"),
        (F.sum("hit") / references).alias("n_loc_ref"),
    )
