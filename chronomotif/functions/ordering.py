"""Neighbours and places of rows in the order of their group, also where one group holds most rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomotif.storage import saved

#: Rows of a group in one window at least, and slices of all rows at most: a larger group is cut by its order.
SLICE_ROWS, SLICES = 100_000, 1_024


def slices(rows: DataFrame, key: list[str], order: str) -> DataFrame | None:
    """Groups too large for one window, with the values of the order at which they are cut; None where there is none.

    Groups and cuts are at most twice ``SLICES`` together, few enough to be sent to every task.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    total = rows.count()
    most = max(SLICE_ROWS, -(-total // SLICES))
    if total <= most:
        return None
    large = sizes.filter(F.col("_n") > most).select(*key, F.ceil(F.col("_n") / most).cast("int").alias("_cuts")).collect()
    if not large:
        return None
    table = F.broadcast(rows.sparkSession.createDataFrame(large, rows.select(*key, F.lit(0).alias("_cuts")).schema))
    finest = max(r["_cuts"] for r in large)
    shares = F.lit([k / finest for k in range(1, finest)])
    found = rows.join(table, key).groupBy(*key, "_cuts").agg(F.percentile_approx(order, shares, F.lit(20 * finest)).alias("_at"))
    # As many cuts as the group needs, of those that the largest needs.
    own = F.transform(F.sequence(F.lit(1), F.col("_cuts") - 1), lambda k: F.get("_at", F.floor(k * finest / F.col("_cuts")).cast("int") - 1))
    return found.select(*key, own.alias("_at"))


def in_order(rows: DataFrame, key: list[str], order: str, ahead: Iterable[str] = (), behind: Iterable[str] = (), place: str | None = None) -> DataFrame:
    """``rows`` with ``next_c`` for each c of ``ahead`` and ``prev_c`` for each of ``behind``: of the next and the previous row of the group.

    ``place`` names a column for the row's place, from 1. The order has no nulls,
    and in a group no value twice. Large groups are cut into slices by their
    order, each a window by itself; where a slice ends, its neighbours come from
    a table with a row for each slice.
    """
    ahead, behind = list(ahead), list(behind)
    cuts = slices(rows, key, order)
    if cuts is not None:
        cuts = F.broadcast(cuts)
        at = F.when(F.col("_at").isNull(), 0).otherwise(F.size(F.filter("_at", lambda b: b < F.col(order))))
        cut = rows.join(cuts, key, "left").select(*rows.columns, at.alias("_slice"))
    else:
        cut = rows.withColumn("_slice", F.lit(0))
    w = Window.partitionBy(*key, *(["_slice"] if cuts is not None else [])).orderBy(order)
    near = [F.lead(order).over(w).isNotNull().alias("_has_next"), F.lag(order).over(w).isNotNull().alias("_has_prev")] if cuts is not None else []
    out = cut.select(
        *rows.columns,
        "_slice",
        *(F.lead(c).over(w).alias(f"next_{c}") for c in ahead),
        *(F.lag(c).over(w).alias(f"prev_{c}") for c in behind),
        *([F.row_number().over(w).cast("long").alias(place)] if place else []),
        *near,
    )
    if cuts is None:
        return out.drop("_slice")
    ends = cut.join(cuts.select(*key), key, "left_semi").groupBy(*key, "_slice").agg(
        F.min_by(F.struct(order, *(c for c in ahead if c != order)), order).alias("_head"), F.max_by(F.struct(order, *(c for c in behind if c != order)), order).alias("_tail"), F.count("*").alias("_n")
    )
    v = Window.partitionBy(*key).orderBy("_slice")  # a row for each slice
    borders = ends.select(*key, "_slice", F.lead("_head").over(v).alias("_head"), F.lag("_tail").over(v).alias("_tail"), (F.sum("_n").over(v) - F.col("_n")).alias("_before"))
    both = out.join(F.broadcast(borders), [*key, "_slice"], "left")
    return both.select(
        *rows.columns,
        *(F.when(F.col("_has_next"), F.col(f"next_{c}")).otherwise(F.col("_head")[c]).alias(f"next_{c}") for c in ahead),
        *(F.when(F.col("_has_prev"), F.col(f"prev_{c}")).otherwise(F.col("_tail")[c]).alias(f"prev_{c}") for c in behind),
        *([(F.col(place) + F.coalesce("_before", F.lit(0))).alias(place)] if place else []),
    )


def running(rows: DataFrame, order: list[Column], sums: Iterable[str] = (), maxima: Iterable[str] = ()) -> DataFrame:
    """``rows`` with columns summed up, or their greatest, from the first row in order to each; the order tells rows apart.

    Rows are dealt by ranges of the order; a row for each range tells what those
    before it bring.
    """
    sums, maxima = list(sums), list(maxima)
    kept = [c for c in rows.columns if c not in {*sums, *maxima}]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "running")
    v = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    brought = dealt.groupBy("_part").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))
    before = brought.select("_part", *(F.sum(c).over(v).alias(f"_{c}") for c in sums), *(F.max(c).over(v).alias(f"_{c}") for c in maxima))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.select("*", *(F.sum(c).over(w).alias(f"_run_{c}") for c in sums), *(F.max(c).over(w).alias(f"_run_{c}") for c in maxima)).join(F.broadcast(before), "_part")
    return both.select(
        *kept, *((F.col(f"_run_{c}") + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums), *(F.greatest(f"_run_{c}", f"_{c}").alias(c) for c in maxima)
    )
