"""Global row numbers without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomotif.storage import saved


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers in an order that tells rows apart.

    Rows are dealt by ranges of the order; each range is numbered by itself,
    from where those before it end.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each range
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_place", place).join(offsets, "_part").select(*df.columns, (F.col("_place") + F.col("_before") - 1 + start).cast("long").alias(name))
