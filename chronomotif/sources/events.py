"""Event lists, node types and type descriptions; events from other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomotif.functions.numbering import numbered


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of a text file, by its place; blank lines are left out.

    Lines are numbered by file and by offset in it, as the splits are read.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return lines.select(F.col("at").alias("line_no"), "value")


def read_events(spark: SparkSession, path: str, assume_sorted: bool = False) -> DataFrame:
    """Events from lines ``start duration from to [type]``, parted by blanks or tabs; a type that isn't given is 1.

    Ids follow the start, then the line; with ``assume_sorted`` the line alone.
    Lines that don't parse, or that join a node with itself, raise when read.
    """
    lines = _numbered_lines(spark, path)
    part = F.split(F.regexp_replace(F.col("value"), r"^\s+|\s+$", ""), r"\s+")
    number = lambda k: F.try_element_at(part, F.lit(k + 1)).try_cast("long")
    rows = lines.select(
        "line_no",
        number(0).alias("start"),
        (number(0) + number(1)).alias("end"),
        number(2).alias("src"),
        number(3).alias("dst"),
        F.coalesce(number(4), F.lit(1)).cast("int").alias("etype"),
        "value",
    )
    bad = F.col("end").isNull() | F.col("dst").isNull() | F.col("src").isNull() | (F.col("src") == F.col("dst"))
    rows = rows.withColumn("src", F.when(bad, F.raise_error(F.concat(F.lit("not an event: "), "value")).cast("long")).otherwise(F.col("src")))
    order = ["line_no"] if assume_sorted else ["start", "line_no"]
    return numbered(rows.drop("value"), order, "event_id").select("event_id", "start", "end", "src", "dst", "etype")


def read_node_types(spark: SparkSession, path: str) -> DataFrame:
    """``node, ntype`` from lines ``node type``; the last line of a node counts."""
    part = F.split(F.regexp_replace(F.col("value"), r"^\s+|\s+$", ""), r"\s+")
    rows = _numbered_lines(spark, path).select("line_no", F.get(part, F.lit(0)).cast("long").alias("node"), F.get(part, F.lit(1)).cast("int").alias("ntype"))
    return rows.groupBy("node").agg(F.max_by("ntype", "line_no").alias("ntype"))


def read_type_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``kind, id, name, short_name, colour, edge_colour`` from a file with ``#NODES`` and ``#EVENTS`` sections.

    A name can be quoted. A line that doesn't parse ends its section.
    """
    lines = _numbered_lines(spark, path)
    w = Window.orderBy("line_no")  # such files have a line for each type
    head = F.when(F.col("value").rlike(r"^\s*#NODES"), "node").when(F.col("value").rlike(r"^\s*#EVENTS"), "event").when(F.col("value").rlike(r"^\s*#"), "other")
    rows = lines.withColumn("head", head).withColumn("kind", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("node")))
    rows = rows.filter("head is null").withColumn("ok", F.col("value").rlike(r"^\s*\d+\s+\S")).filter("kind <> 'other'")
    rows = rows.withColumn("broken", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("kind").orderBy("line_no"))).filter("broken = 0")
    words = F.regexp_extract_all("value", F.lit(r'("[^"]*"|\S+)'), F.lit(1))
    rows = rows.withColumn("p", F.transform(words, lambda x: F.regexp_replace(x, '^"|"$', "")))
    at = lambda k: F.try_element_at("p", F.lit(k))
    n = F.size("p")
    return rows.select(
        "kind",
        at(1).cast("int").alias("id"),
        at(2).alias("name"),
        F.when(n >= 4, at(3)).alias("short_name"),
        F.when(n >= 4, at(4)).when(n == 3, at(3)).alias("colour"),
        F.when(n >= 5, at(5)).alias("edge_colour"),
    )


def write_events(events: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", *(c.cast("string") for c in (F.col("start"), F.col("end") - F.col("start"), F.col("src"), F.col("dst"), F.col("etype"))))
    events.orderBy("event_id").select(line.alias("value")).write.text(path)


#: Items are numbered from here, apart from users.
ITEMS_FROM = 1_000_000


def user_item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a network from users to items; types by name, 1 for the first."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    names = raw.select("event_type").distinct()
    codes = names.select("event_type", F.row_number().over(Window.orderBy("event_type")).alias("etype"))  # a row for each type
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    item = F.regexp_extract("props", r"\d+", 0).cast("long") + ITEMS_FROM
    return raw.join(F.broadcast(codes), "event_type").select("event_id", start.alias("start"), start.alias("end"), F.col("user_id").alias("src"), item.alias("dst"), "etype")


def user_item_types(events: DataFrame) -> DataFrame:
    """``node, ntype``: users 10 or 11 by parity, items 20."""
    users = events.select(F.col("src").alias("node")).distinct().select("node", (F.lit(10) + F.col("node") % 2).cast("int").alias("ntype"))
    items = events.select(F.col("dst").alias("node")).distinct().select("node", F.lit(20).alias("ntype"))
    return users.unionByName(items)
