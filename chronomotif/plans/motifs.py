"""Finding motifs: from events to a report with its null model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.operators import adjacency, components, network, nullmodel, shuffles, subgraphs
from chronomotif.storage import saved


@dataclass
class MotifSpec:
    """Parameters of a search. ``references``: None for none, 0 for exact expectations, R for R seeded draws."""

    tw: int
    max_size: int | None = None
    maximal: bool = False
    references: int | None = None
    time_gap: int = 0
    weight_omit: float = 0.0
    allow_multiple_event_types: bool = False
    hypothesis: int = 0
    shuffle: int = -1
    seed: int | None = None
    #: Leave out motifs whose edges aren't in a prefix-connected order.
    compat: bool = False

    def __post_init__(self) -> None:
        if self.tw < 0 or self.time_gap < 0:
            raise ValueError("times can't be negative")
        if self.max_size is not None and self.max_size < 0:
            raise ValueError("max_size is 0 or more")
        # 0 is as large as there are; without maximal sets, that is every connected set of events.
        self.max_size = self.max_size or None
        if self.hypothesis not in (0, 1, 2):
            raise ValueError("hypothesis is 0, 1 or 2")
        if self.seed is None and (self.references or self.shuffle >= 0):
            raise ValueError("a seed is needed")


def checked(events: DataFrame, node_types: DataFrame | None) -> None:
    """Raise where an event loops, or a number is a type both of nodes and of events."""
    if events.filter("src = dst").limit(1).count():
        raise ValueError("an event joins a node with itself")
    if node_types is not None:
        types = node_types.select(F.col("ntype").alias("t")).distinct().join(events.select(F.col("etype").alias("t")).distinct(), "t")
        if types.limit(1).count():
            raise ValueError("types of nodes and of events must not share numbers")


def find_sets(events: DataFrame, spec: MotifSpec) -> DataFrame:
    """Valid sets of events with their edges."""
    adjacent = saved(adjacency.within(adjacency.next_events(events), spec.tw), "adjacent")
    comp = saved(components.maximal_subgraphs(events, spec.tw, adjacent), "maximal")
    if spec.maximal:
        return subgraphs.maximal_sets(events, comp, spec.max_size, spec.time_gap)
    return subgraphs.valid_sets(events, adjacent, comp, spec.max_size, spec.time_gap)


def motif_counts(sets: DataFrame, node_types: DataFrame | None, spec: MotifSpec) -> DataFrame:
    """``motif, count, n_loc`` of sets; those of mixed types only if they are allowed."""
    places = subgraphs.location_counts(sets)
    if not spec.allow_multiple_event_types:
        places = places.filter(F.size(F.array_distinct(F.transform("edges", lambda e: e["etype"]))) == 1)
    named = network.with_motifs(places, node_types, spec.hypothesis)
    return named.groupBy("motif").agg(F.sum("cnt").alias("count"), F.count("*").alias("n_loc"))


def binned_edges(events: DataFrame, node_types: DataFrame | None, spec: MotifSpec) -> DataFrame:
    """``src, dst, etype, w, bin, st, dt``: the typed edges within the time window and the bins, with the types of their ends."""
    seen = adjacency.in_window(events, spec.time_gap)
    limits = nullmodel.bin_limits(nullmodel.omit_heaviest(network.aggregate_net(seen), spec.weight_omit))
    rows = nullmodel.with_bins(network.with_node_types(network.typed_net(seen), node_types).withColumn("ws", F.array("w")), limits)
    return rows.withColumn("bin", F.col("bins")[0]).drop("ws", "bins")


def places_with_counts(events: DataFrame, sets: DataFrame, node_types: DataFrame | None, spec: MotifSpec, length: int) -> DataFrame:
    """All places within the bins: ``edges, ws, bins, cnt, motif, ref_key``."""
    seen = adjacency.in_window(events, spec.time_gap)
    limits = nullmodel.bin_limits(nullmodel.omit_heaviest(network.aggregate_net(seen), spec.weight_omit))
    tnet = saved(network.with_node_types(network.typed_net(seen), node_types), "typed-net")
    space = nullmodel.with_bins(network.edge_sequences(tnet, length, spec.allow_multiple_event_types), limits)
    places = space.join(subgraphs.location_counts(sets), "edges", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return network.with_motifs(places, node_types, spec.hypothesis)


def counted_places(events: DataFrame, sets: DataFrame, node_types: DataFrame | None, spec: MotifSpec, length: int) -> tuple[DataFrame, DataFrame]:
    """Places of up to three edges, not made but counted: totals (``motif, ref_key, bins, n``), and those found (``motif, ref_key, bins, cnt``)."""
    bnet = saved(binned_edges(events, node_types, spec), "binned-net")
    totals = network.keyed(network.place_totals(bnet, length, spec.allow_multiple_event_types), F.col("events"), spec.hypothesis)
    counts = subgraphs.location_counts(sets)
    if not spec.allow_multiple_event_types:
        counts = counts.filter(F.forall("edges", lambda e: e["etype"] == F.col("edges")[0]["etype"]))
    hits = network.with_motifs(network.placed(counts, bnet, length), node_types, spec.hypothesis)
    return saved(totals.select("motif", "ref_key", "bins", "n"), "totals"), saved(hits.select("motif", "ref_key", "bins", "cnt"), "hits")


def find_motifs(events: DataFrame, spec: MotifSpec, node_types: DataFrame | None = None) -> DataFrame:
    """The report: a row for each motif that is found or could be, by count."""
    spark: SparkSession = events.sparkSession
    checked(events, node_types)
    if spec.shuffle >= 0:
        events, node_types = shuffles.shuffled(events, node_types, spec.shuffle, spec.seed)
        events = saved(events, "shuffled")
    sets = saved(find_sets(events, spec), "sets")
    counts = motif_counts(sets, node_types, spec)
    null = lambda kind: F.lit(None).cast(kind)
    length = spec.max_size or sets.agg(F.max(F.size("ids"))).first()[0] or 1
    if spec.references is None:
        report = counts.select("count", null("double").alias("ref_avg"), null("double").alias("ratio"), null("double").alias("ref_std"), null("int").alias("n_ref"), null("int").alias("n_lt_ref"), null("double").alias("z_score"), null("long").alias("n_loc_tot"), "n_loc", null("double").alias("n_loc_ref"), "motif")
        return ordered(report)
    if length <= 3:
        totals, hits = counted_places(events, sets, node_types, spec, length)
        cells, alike = nullmodel.summed_cells(totals, hits), nullmodel.alike_summed(totals, hits)
    else:
        places = saved(places_with_counts(events, sets, node_types, spec, length), "places")
        cells, alike = nullmodel.cells(places), nullmodel.alike_places(places)
    exact = nullmodel.expectation(alike, nullmodel.cell_moments(cells)).withColumnRenamed("n_loc", "n_loc_in")
    how = "right" if spec.compat else "full"
    both = counts.join(exact, "motif", how).withColumn("count", F.coalesce("count", F.lit(0)))
    if spec.references == 0:
        both = both.withColumn("n_ref", null("int")).withColumn("n_lt_ref", null("int")).withColumn("n_loc_ref", null("double"))
    else:
        drawn = nullmodel.drawn_by_cell(saved(alike, "alike"), cells, spec.references, spec.seed)
        draws = nullmodel.statistics(both.select("motif", "count"), saved(drawn, "drawn"), spec.references)
        both = both.drop("ref_avg", "ref_std").join(draws, "motif")
    z = F.when(F.col("ref_std") > 0, (F.col("count") - F.col("ref_avg")) / F.col("ref_std")).otherwise(0.0)
    ratio = F.when(F.col("ref_avg") > 0, F.col("count") / F.col("ref_avg")).otherwise(-1.0)
    report = both.select(
        "count", "ref_avg", ratio.alias("ratio"), "ref_std", "n_ref", "n_lt_ref", z.alias("z_score"), "n_loc_tot", F.coalesce("n_loc", "n_loc_in", F.lit(0)).alias("n_loc"), "n_loc_ref", "motif"
    )
    return ordered(report)


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("count"), "motif")


def by_reference_total(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("ref_avg"), "motif")


def single_reference(report: DataFrame, ref: DataFrame) -> DataFrame:
    """``motif, count, ref, ratio`` against one reference's counts (``motif, count``)."""
    other = ref.select("motif", F.col("count").alias("ref"))
    both = report.select("motif", "count").join(other, "motif", "left").withColumn("ref", F.coalesce("ref", F.lit(0)))
    return both.withColumn("ratio", F.when(F.col("ref") > 0, F.col("count") / F.col("ref")).otherwise(-1.0)).orderBy(F.desc("count"), "motif")


def gap_distribution(sets: DataFrame, node_types: DataFrame | None = None) -> DataFrame:
    """``motif, counts``: for each motif, how many sets have which connecting gap, as an array of ``gap, n``."""
    named = network.with_motifs(sets.select("edges", "gap"), node_types) if node_types is None else network.with_motifs(sets.select("root", "ids", "edges", "gap"), node_types)
    n = named.groupBy("motif", "gap").agg(F.count("*").alias("n"))
    return n.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("gap", "n"))).alias("counts"))
