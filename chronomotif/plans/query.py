"""Queries over motif reports: filter, remap, merge, group, rank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomotif.functions.canonical import basic, canonical, parse, properties, remapped

LEVELS = ("motif", "multigraph", "digraph", "graph")


def parsed(report: DataFrame) -> DataFrame:
    """A report with ``ntypes`` and ``events`` parsed from its motifs."""
    ntypes, events = parse(F.col("motif"))
    return report.withColumn("ntypes", ntypes).withColumn("events", events)


def _policy(types: Column, wanted: list[int], policy: str, others: bool) -> Column:
    """``one``: exactly one listed type is there; ``any``: at least one; ``all``: all; others only if allowed."""
    listed = F.array(*(F.lit(t) for t in wanted))
    present = F.size(F.array_intersect(types, listed))
    if policy == "one":
        ok = present == 1
    elif policy == "any":
        ok = present >= 1
    elif policy == "all":
        ok = present == len(set(wanted))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return ok if others else ok & (F.size(F.array_except(types, listed)) == 0)


@dataclass
class MotifQuery:
    """A query, built up and then run over a report (``count``, ``motif`` and more)."""

    n_events: list[int] | None = None
    n_nodes: list[int] | None = None
    min_count: int | None = None
    node_types: list[int] | None = None
    node_policy: str = "any"
    other_nodes: bool = True
    event_types: list[int] | None = None
    event_policy: str = "any"
    other_events: bool = True
    type_map: dict[int, int] = field(default_factory=dict)
    #: Untyped keys by level; a motif that has one of them at any level is accepted.
    like: dict[str, list[str]] = field(default_factory=dict)
    group_by: str | None = None
    group_typed: bool = False
    order_by: str = "count"
    descending: bool = True
    top: int | None = None

    def filtered(self, report: DataFrame) -> DataFrame:
        """Accepted motifs, their types mapped and those merged that are then the same."""
        df = parsed(report)
        if self.n_events:
            df = df.filter(F.size("events").isin(self.n_events))
        if self.n_nodes:
            df = df.filter(F.size("ntypes").isin(self.n_nodes))
        if self.min_count is not None:
            df = df.filter(F.col("count") >= self.min_count)
        if self.like:
            plain = basic(F.col("ntypes"), F.col("events"))
            accepted = F.lit(False)
            for level, keys in self.like.items():
                accepted = accepted | canonical(*plain, level).isin(keys)
            df = df.filter(accepted)
        ntypes, events = remapped(F.col("ntypes"), F.col("events"), self.type_map)
        df = df.withColumn("ntypes", ntypes).withColumn("events", events)
        kinds = F.array_distinct(F.transform("events", lambda e: e["c"]))
        if self.node_types:
            df = df.filter(_policy(F.array_distinct("ntypes"), self.node_types, self.node_policy, self.other_nodes))
        if self.event_types:
            df = df.filter(_policy(kinds, self.event_types, self.event_policy, self.other_events))
        if self.type_map:
            df = df.withColumn("motif", canonical(F.col("ntypes"), F.col("events")))
            df = df.groupBy("motif").agg(F.sum("count").alias("count"), F.first("ntypes").alias("ntypes"), F.first("events").alias("events"), *(F.sum(c).alias(c) for c in report.columns if c == "ref_avg"))
        return df

    def run(self, report: DataFrame) -> DataFrame:
        """Filtered motifs with ``grp``, ``rel_count`` and ``place`` in their group, up to ``top`` of each."""
        df = self.filtered(report)
        if self.group_by is None:
            df = df.withColumn("grp", F.lit("all"))
        else:
            forms = (F.col("ntypes"), F.col("events")) if self.group_typed or self.group_by == "nodes" else basic(F.col("ntypes"), F.col("events"))
            df = df.withColumn("grp", canonical(*forms, self.group_by))
        group = Window.partitionBy("grp")
        df = df.withColumn("rel_count", F.col("count") / F.sum("count").over(group))
        by = F.col(self.order_by)
        order = by.desc() if self.descending else by.asc()
        df = df.withColumn("place", F.row_number().over(group.orderBy(order, "motif")))
        return df.filter(F.col("place") <= self.top) if self.top else df


def with_levels(report: DataFrame) -> DataFrame:
    """A report with the untyped key of every level, and the properties of its motifs."""
    df = parsed(report)
    plain = basic(F.col("ntypes"), F.col("events"))
    for level in LEVELS:
        df = df.withColumn(f"{level}_key", canonical(*plain, level))
    for name, c in properties(F.col("ntypes"), F.col("events")).items():
        df = df.withColumn(name, c)
    return df


def chart_labels(report: DataFrame) -> DataFrame:
    """``motif, label``: untyped motifs under ``a-b-c-d`` labels: graphs by size, their digraphs, multigraphs, motifs."""
    df = with_levels(report).select(*(f"{x}_key" for x in LEVELS), "nof_nodes", "nof_events", "nof_edges", "nof_dir_edges").distinct()
    # As many rows as there are topologies.
    a = F.dense_rank().over(Window.orderBy("nof_nodes", "nof_edges", "graph_key"))
    b = F.dense_rank().over(Window.partitionBy("graph_key").orderBy("nof_dir_edges", "digraph_key"))
    c = F.dense_rank().over(Window.partitionBy("digraph_key").orderBy("nof_events", "multigraph_key"))
    d = F.dense_rank().over(Window.partitionBy("multigraph_key").orderBy("motif_key"))
    return df.select(F.col("motif_key").alias("motif"), F.concat_ws("-", a, b, c, d).alias("label"))


def merged_files(reports: list[tuple[str, DataFrame]]) -> DataFrame:
    """Reports one under the other, with the name of each as ``source_file``."""
    out = None
    for name, df in reports:
        df = df.withColumn("source_file", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no reports")
    return out


def distribution_median(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``median``: the first index at which the running sum of a distribution reaches one half."""
    running = F.aggregate(column, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(-1).alias("at")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["k"] + 1).alias("k"), F.when((a["at"] < 0) & (a["s"] + x >= 0.5 - 1e-12), a["k"]).otherwise(a["at"]).alias("at")))
    return df.withColumn("median", running["at"])
