"""Columns from delimited text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_columns(
    spark: SparkSession,
    path: str,
    columns: list[int] | list[str] | None = None,
    types: list[str] | None = None,
    fun: Callable[[Column], Column] | None = None,
    sep: str | None = None,
    header: bool = False,
    skip: int = 0,
) -> DataFrame:
    """Columns of a text file, by number or name, cast to types, inferred if not given; ``fun`` maps each.

    Without ``sep``, blanks part them. ``skip`` leaves out so many first lines.
    A value that can't be cast raises when it is read, and the error names its
    line and column.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    lines = _with_line_numbers(lines) if types else lines.withColumn("_line", F.lit(None).cast("long"))
    if skip or header:
        first = lines.orderBy("at").limit(skip + header).collect()
        names = (first[-1]["value"].split(sep) if sep else first[-1]["value"].split()) if header and first else None
        lines = lines.filter(F.col("at") > first[-1]["at"]) if first else lines
    else:
        names = None
    text = lines.filter(F.trim("value") != "").select(F.trim("value").alias("value") if sep is None else F.col("value"), "_line")
    part = F.split("value", r"\s+" if sep is None else "\\Q" + sep + "\\E")
    one = text.select(F.size(part).alias("n")).first()
    width = one["n"] if one else len(names or [])
    names = names or [f"c{k}" for k in range(width)]
    chosen = list(names) if columns is None else [names[c] if isinstance(c, int) else c for c in columns]
    rows = text.select(*(F.get(part, F.lit(names.index(n))).alias(n) for n in chosen), "_line")
    if types:
        rows = rows.select(*(_checked(c, k, names.index(c) + 1) for c, k in zip(chosen, types, strict=True)))
    else:
        rows = rows.select(*chosen)
        rows = rows.select(*(F.col(c).cast(k).alias(c) for c, k in zip(chosen, inferred(rows), strict=True)))
    return rows.select(*(fun(F.col(c)).alias(c) for c in rows.columns)) if fun else rows


def _with_line_numbers(lines: DataFrame) -> DataFrame:
    """Lines (``at``, of the splits as they are read) with ``_line``, from 1: those of the splits before are counted, a row for each split."""
    split, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(2**33 - 1))
    ends = lines.groupBy(split.alias("_split")).agg((F.max(row) + 1).alias("_n"))
    before = ends.select("_split", (F.sum("_n").over(Window.orderBy("_split")) - F.col("_n")).alias("_before"))
    return lines.withColumn("_split", split).join(F.broadcast(before), "_split").withColumn("_line", F.col("_before") + row + 1).drop("_split", "_before")


def _checked(name: str, kind: str, number: int) -> Column:
    """A column cast to a type; what can't be raises with its line, its column's number and name, and its text."""
    told = F.concat(F.lit("line "), F.col("_line").cast("string"), F.lit(f", column {number} ({name}): "), F.col(name), F.lit(f" is no {kind}"))
    value = F.col(name).try_cast(kind)
    return F.when(F.col(name).isNotNull() & value.isNull(), F.raise_error(told).cast(kind)).otherwise(value).alias(name)


def inferred(rows: DataFrame) -> list[str]:
    """``long``, ``double`` or ``string`` for each column: the first that all its values can be cast to."""
    if not rows.columns:
        return []
    fits = rows.agg(*(F.bool_and(F.col(c).isNull() | F.col(c).try_cast(k).isNotNull()).alias(f"{c}:{k}") for c in rows.columns for k in ("long", "double"))).first()
    return ["long" if fits[f"{c}:long"] else "double" if fits[f"{c}:double"] else "string" for c in rows.columns]


def read_data(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    return read_columns(spark, path, skip=skip)
