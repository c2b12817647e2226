"""Networks and what belongs to their nodes: readers and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.functions.numbering import numbered
from chronomotif.sources.events import _numbered_lines
from chronomotif.sources.tables import inferred
from chronomotif.storage import saved

MATRICES = ("square", "upperdiag", "supperdiag", "lowerdiag", "slowerdiag")


@dataclass
class Graph:
    """A weighted network: ``edges`` (``u, v, w``, undirected ones once, ``u < v``) and all its ``nodes`` (``node``)."""

    edges: DataFrame
    nodes: DataFrame
    directed: bool = False

    @staticmethod
    def of(edges: DataFrame, directed: bool = False, nodes: DataFrame | None = None) -> Graph:
        """A network of edges; those given twice are summed, and self-edges give isolated nodes."""
        ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
        all_nodes = (ends if nodes is None else ends.unionByName(nodes.select("node"))).distinct()
        edges = edges.filter("u <> v")
        if not directed:
            edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
        return Graph(edges.groupBy("u", "v").agg(F.sum("w").alias("w")), all_nodes, directed)

    def both_ways(self) -> DataFrame:
        """Every edge from both its ends."""
        return self.edges.unionByName(self.edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))

    def without_nodes(self, nodes: DataFrame) -> Graph:
        gone = nodes.select("node").distinct()
        edges = self.edges.join(gone, F.col("u") == F.col("node"), "left_anti").join(gone, F.col("v") == F.col("node"), "left_anti")
        return Graph(edges, self.nodes.join(gone, "node", "left_anti"), self.directed)

    def with_edges(self, edges: DataFrame) -> Graph:
        """Edges set to new weights, the others as they are; weight 0 takes an edge away."""
        new = edges if self.directed else edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
        kept = self.edges.join(new.select("u", "v"), ["u", "v"], "left_anti").unionByName(new.filter("w <> 0"))
        nodes = self.nodes.unionByName(new.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
        return Graph(kept, nodes, self.directed)


def read_edg(spark: SparkSession, path: str, directed: bool = False, sep: str | None = None, header: bool = False, mutual: bool = False, numeric: bool = False) -> Graph:
    """An edge list ``from to [weight]``; a missing weight is 1. ``mutual`` keeps edges that are there both ways."""
    lines = _numbered_lines(spark, path)
    if header:
        lines = lines.filter(F.col("line_no") > F.lit(lines.agg(F.min("line_no")).first()[0]))
    part = F.split(F.trim("value"), r"\s+" if sep is None else "\\Q" + sep + "\\E")
    kind = "long" if numeric else "string"
    edges = lines.select(F.get(part, F.lit(0)).cast(kind).alias("u"), F.get(part, F.lit(1)).cast(kind).alias("v"), F.coalesce(F.get(part, F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    if mutual:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()
        edges = edges.join(back, ["u", "v"], "left_semi")
    return Graph.of(edges, directed)


def read_gml(spark: SparkSession, path: str) -> Graph:
    """The directed flag and the edges (source, target, value) of a GML file."""
    text = spark.read.text(path, wholetext=True)
    directed = bool(text.filter(F.col("value").rlike(r"(?m)^\s*directed\s+1")).limit(1).count())
    edge = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\bedge\s*\[(.*?)\]"), F.lit(1))).alias("e"))
    node = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\bnode\s*\[[^\]]*?\bid\s+(\S+)"), F.lit(1))).alias("node"))
    field = lambda name: F.regexp_extract("e", rf"\b{name}\s+(\S+)", 1)
    edges = edge.select(field("source").alias("u"), field("target").alias("v"), F.coalesce(field("value").try_cast("double"), F.lit(1.0)).alias("w"))
    return Graph.of(edges, directed, node)


def read_matrix(spark: SparkSession, path: str, kind: str = "square", directed: bool = False) -> Graph:
    """A weight matrix in text: whole, or a triangle with or without (``s``) its diagonal. Nodes are numbers from 0; zeros are no edges."""
    if kind not in MATRICES:
        raise ValueError(f"a matrix is one of {', '.join(MATRICES)}")
    lines = _numbered_lines(spark, path)
    rows = numbered(lines, ["line_no"], "i").select("i", "value")
    rows = rows.select("i", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("k", "x"))
    shift = {"square": F.lit(0), "lowerdiag": F.lit(0), "slowerdiag": F.lit(0), "upperdiag": F.col("i"), "supperdiag": F.col("i") + 1}[kind]
    row = F.col("i") + 1 if kind == "slowerdiag" else F.col("i")
    cells = rows.select(row.cast("long").alias("u"), (F.col("k") + shift).cast("long").alias("v"), F.col("x").cast("double").alias("w"))
    if kind == "square" and not directed:
        cells = cells.filter("u <= v")
    nodes = cells.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return Graph.of(cells.filter("w <> 0"), directed, nodes)


READERS = {"edg": read_edg, "gml": read_gml, "mat": read_matrix}


def file_type(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def load_net(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Graph:
    """A network by its format, or its file's suffix."""
    fmt = fmt or file_type(path)
    if fmt in ("net", "adj"):
        raise NotImplementedError(f"the format {fmt!r} can be written but not read")
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    return READERS[fmt](spark, path, **options)


def write_edg(graph: Graph, path: str, header: bool = False) -> None:
    rows = graph.edges.select(F.col("u").alias("HEAD"), F.col("v").alias("TAIL"), F.col("w").alias("WEIGHT"))
    rows.write.csv(path, sep="\t", header=header)


def _numbers(graph: Graph, start: int) -> DataFrame:
    """``node, n``: numbers in order of the nodes."""
    return saved(numbered(graph.nodes.select("node"), ["node"], "n", start), "node-numbers")


def _one_file(parts: list[DataFrame], path: str) -> None:
    """Lines (``a, b, value``) of several parts, in order, as one text file: formats that are one document."""
    rows = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("part"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "value")
        rows = p if rows is None else rows.unionByName(p)
    rows.orderBy("part", "a", "b").select("value").coalesce(1).write.text(path)


def _line(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, 0, text)], "a long, b long, value string")


def write_gml(graph: Graph, path: str) -> None:
    spark = graph.edges.sparkSession
    n = _numbers(graph, 0)
    nodes = n.select(F.col("n").alias("a"), F.lit(0).alias("b"), F.format_string('  node [\n    id %d\n    label "%s"\n  ]', F.col("n"), F.col("node").cast("string")).alias("value"))
    edges = _numbered_edges(graph, n).select(F.col("a"), F.col("b"), F.format_string("  edge [\n    source %d\n    target %d\n    value %s\n  ]", "a", "b", F.col("w").cast("string")).alias("value"))
    _one_file([_line(spark, f"graph [\n  directed {int(graph.directed)}"), nodes, edges, _line(spark, "]")], path)


def _numbered_edges(graph: Graph, n: DataFrame) -> DataFrame:
    first, second = n.select(F.col("node").alias("u"), F.col("n").alias("a")), n.select(F.col("node").alias("v"), F.col("n").alias("b"))
    return graph.edges.join(first, "u").join(second, "v")


def write_pajek(graph: Graph, path: str) -> None:
    spark = graph.edges.sparkSession
    n = _numbers(graph, 1)
    nodes = n.select(F.col("n").alias("a"), F.lit(0).alias("b"), F.format_string('%d "%s"', F.col("n"), F.col("node").cast("string")).alias("value"))
    edges = _numbered_edges(graph, n).select("a", "b", F.concat_ws(" ", F.col("a"), F.col("b"), F.col("w").cast("string")).alias("value"))
    _one_file([_line(spark, f"*Vertices {n.count()}"), nodes, _line(spark, "*Arcs" if graph.directed else "*Edges"), edges], path)


def write_matrix(graph: Graph, path: str, kind: str = "square") -> None:
    """A row of weights for each node, in order. The format holds a cell for each pair of nodes: for small networks."""
    if kind not in MATRICES:
        raise ValueError(f"a matrix is one of {', '.join(MATRICES)}")
    n = _numbers(graph, 0)
    size = n.count()
    edges = _numbered_edges(graph, n).select("a", "b", "w")
    if not graph.directed:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    rows = edges.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    rows = n.select(F.col("n").alias("a")).join(rows, "a", "left")
    lo = {"square": F.lit(0), "upperdiag": F.col("a"), "supperdiag": F.col("a") + 1, "lowerdiag": F.lit(0), "slowerdiag": F.lit(0)}[kind]
    hi = {"square": F.lit(size), "upperdiag": F.lit(size), "supperdiag": F.lit(size), "lowerdiag": F.col("a") + 1, "slowerdiag": F.col("a")}[kind]
    columns = F.filter(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), lambda j: (j >= lo) & (j < hi))
    value = lambda j: F.coalesce(F.try_element_at("m", j.cast("int")), F.lit(0.0)).cast("string")
    lines = rows.select("a", F.lit(0).alias("b"), F.array_join(F.transform(columns, value), " ").alias("value")).filter("value <> ''")
    _one_file([lines], path)


def write_adjacency(graph: Graph, path: str) -> None:
    """A line for each node: itself and its neighbours."""
    ways = graph.edges if graph.directed else graph.both_ways()
    near = ways.groupBy(F.col("u").alias("node")).agg(F.array_sort(F.collect_list(F.col("v").cast("string"))).alias("near"))
    graph.nodes.join(near, "node", "left").select(F.concat_ws(" ", F.col("node").cast("string"), "near").alias("value")).write.text(path)


WRITERS = {"edg": write_edg, "gml": write_gml, "net": write_pajek, "mat": write_matrix, "adj": write_adjacency}


def write_net(graph: Graph, path: str, fmt: str | None = None, **options) -> None:
    fmt = fmt or file_type(path)
    if fmt not in WRITERS:
        raise ValueError(f"unknown format {fmt!r}")
    WRITERS[fmt](graph, path, **options)


def read_properties(spark: SparkSession, graph: Graph, path: str, sep: str = "\t", missing: bool = True, extra: bool = True) -> DataFrame:
    """A table of node properties with a ``node_label`` column, its types inferred.

    Unless allowed, a node without a row, or a row without a node, raises.
    """
    rows = spark.read.csv(path, sep=sep, header=True)
    if "node_label" not in rows.columns:
        raise ValueError("the header has no node_label")
    rows = rows.select(*(F.col(c).cast(k).alias(c) for c, k in zip(rows.columns, inferred(rows), strict=True)))
    label = graph.nodes.select(F.col("node").cast("string").alias("node"))
    known = rows.select(F.col("node_label").cast("string").alias("node"))
    if not missing and label.join(known, "node", "left_anti").limit(1).count():
        raise ValueError("a node has no properties")
    if not extra and known.join(label, "node", "left_anti").limit(1).count():
        raise ValueError("a row has no node")
    return rows.join(label, F.col("node_label").cast("string") == F.col("node"), "left_semi")


def write_properties(properties: DataFrame, path: str, sep: str = "\t") -> None:
    properties.write.csv(path, sep=sep, header=True)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """``node, comm``: the nodes of each line; communities are numbered by size, the largest first."""
    lines = _numbered_lines(spark, path).select("line_no", F.array_distinct(F.split(F.trim("value"), r"\s+")).alias("nodes"))
    lines = lines.select(F.size("nodes").alias("n"), F.array_min("nodes").alias("first"), "line_no", "nodes")
    return numbered(lines, [F.desc("n"), "first", "line_no"], "comm").select(F.explode("nodes").alias("node"), "comm")


def write_communities(membership: DataFrame, path: str) -> None:
    rows = membership.groupBy("comm").agg(F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("nodes"))
    rows.orderBy(F.size("nodes").desc(), "comm").select(F.array_join("nodes", " ").alias("value")).write.text(path)
