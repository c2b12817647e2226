"""Percentiles and cumulative distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row, ``percentile``: linear between the values next to place p*(n-1)."""
    return df.agg(F.percentile(column, F.lit(p)).alias("percentile"))


def cumulative(df: DataFrame, column: str, weight: str | None = None, upwards: bool = False) -> DataFrame:
    """``value, share``: the share of rows, or of weight, at or above each value; at or below it if ``upwards``. The last is 1."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = df.groupBy(F.col(column).alias("value")).agg(F.sum(w).alias("m"))
    order = F.col("value").asc() if upwards else F.col("value").desc()
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct value
    total = F.sum("m").over(Window.partitionBy())
    last = F.lead("value").over(Window.orderBy(order)).isNull()
    return sums.select("value", F.when(last, 1.0).otherwise(F.sum("m").over(run) / total).alias("share"))


def mean_pairwise(df: DataFrame, distance) -> DataFrame:
    """One row, ``mean``: of a distance over all pairs of a small set (``id`` and what the distance reads, as ``a_`` and ``b_`` columns)."""
    a = df.select(*(F.col(c).alias(f"a_{c}") for c in df.columns))
    b = df.select(*(F.col(c).alias(f"b_{c}") for c in df.columns))
    return a.join(b, F.col("a_id") > F.col("b_id")).agg(F.avg(distance).alias("mean"))
