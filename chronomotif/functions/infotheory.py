"""Entropies of joint distributions held as rows with a probability ``p``, in bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _plogp(p):
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def probabilities(df: DataFrame, by: list[str]) -> DataFrame:
    """The distribution of rows over the columns ``by``."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(*by, (F.col("n") / F.col("total")).alias("p"))  # one row


def entropy(dist: DataFrame) -> DataFrame:
    """One row, ``entropy``, of a distribution; its zeros count for nothing."""
    return dist.agg((-F.sum(_plogp(F.col("p")))).alias("entropy"))


def normalised_entropy(dist: DataFrame) -> DataFrame:
    """Entropy by the most it can be for as many outcomes; 1 for one outcome or none."""
    sums = dist.filter("p > 0").agg((-F.sum(_plogp(F.col("p")))).alias("h"), F.count("*").alias("k"))
    return sums.select(F.when(F.col("k") > 1, F.col("h") / F.log2(F.greatest(F.col("k"), F.lit(2)).cast("double"))).otherwise(1.0).alias("entropy"))


def conditional_entropy(dist: DataFrame, given: list[str]) -> DataFrame:
    """H(everything | given) of a joint distribution: one row, ``entropy``."""
    share = F.sum("p").over(Window.partitionBy(*given))
    rows = dist.filter("p > 0").withColumn("q", share)
    return rows.agg((-F.sum(F.col("p") * F.log2(F.col("p") / F.col("q")))).alias("entropy"))


def conditional_mutual_information(dist: DataFrame, x: list[str], y: list[str], z: list[str]) -> DataFrame:
    """I(X; Y | Z): one row, ``information``."""
    of = lambda cols: dist.groupBy(*cols).agg(F.sum("p").alias("p"))
    parts = [conditional_entropy(of(c), z) for c in ([*x, *z], [*y, *z], [*x, *y, *z])]
    named = [p.withColumnRenamed("entropy", f"h{k}") for k, p in enumerate(parts)]
    return named[0].crossJoin(named[1]).crossJoin(named[2]).select((F.col("h0") + F.col("h1") - F.col("h2")).alias("information"))  # a row each
