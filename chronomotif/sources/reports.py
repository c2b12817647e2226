"""Motif reports as text and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomotif.functions.ordering import running
from chronomotif.sources.events import _numbered_lines

COLUMNS = ("count", "ref_avg", "ratio", "ref_std", "n_ref", "n_lt_ref", "z_score", "n_loc_tot", "n_loc", "n_loc_ref", "motif")
WIDTH = 14


def write_report(report: DataFrame, path: str) -> None:
    """A header and fixed-width columns, left-aligned, the motif last; by count. One file, as a report is read by people."""
    cell = lambda c: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), WIDTH, " ")
    rows = report.select(F.lit(1).alias("part"), "count", "motif", F.concat(*(cell(c) for c in COLUMNS[:-1]), F.col("motif")).alias("value"))
    head = "".join(c.ljust(WIDTH) for c in COLUMNS[:-1]) + "motif"
    first = report.sparkSession.createDataFrame([(0, None, None, head)], "part int, count long, motif string, value string")
    first.unionByName(rows).orderBy("part", F.desc("count"), "motif").select("value").coalesce(1).write.text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as it was written; of a motif that comes again, the last line counts. A header is optional."""
    lines = _numbered_lines(spark, path).filter(~F.col("value").rlike(r"^\s*count\b"))
    found = F.regexp_extract("value", r"^(.*?)(\[.*)$", 1)
    part = F.split(F.trim(found), r"\s+")
    kinds = dict(zip(COLUMNS, ("long", "double", "double", "double", "int", "int", "double", "long", "long", "double"), strict=False))
    cols = [F.try_element_at(part, F.lit(k + 1)).try_cast(kinds[c]).alias(c) for k, c in enumerate(COLUMNS[:-1])]
    rows = lines.select("line_no", *cols, F.trim(F.regexp_extract("value", r"^(.*?)(\[.*)$", 2)).alias("motif")).filter("motif <> ''")
    last = Window.partitionBy("motif").orderBy(F.desc("line_no"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select(*COLUMNS)


def save(report: DataFrame, path: str) -> None:
    report.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A file of ``#NODES``, ``#EVENTS`` and ``#MOTIFS`` sections: its lines by section, as ``nodes``, ``events``, ``motifs``."""
    name = F.lower(F.regexp_extract("value", r"^\s*#(\w+)", 1))
    lines = _numbered_lines(spark, path).withColumn("name", name).withColumn("begun", F.when(F.col("name") != "", F.col("line_no")))
    # Each line's section is that of the last heading so far: a running maximum over ranges of lines.
    rows = running(lines, [F.col("line_no")], maxima=["begun"])
    heads = lines.filter("name <> ''").select(F.col("line_no").alias("begun"), F.col("name").alias("section"))
    rows = rows.filter("name = ''").join(heads, "begun")
    return {s: rows.filter(F.col("section") == s).select("line_no", "value") for s in ("nodes", "events", "motifs")}


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
