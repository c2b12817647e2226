"""More queries of the engine over the test tables, with SQL: files, options of the null model, shuffles, cliques, communities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.functions import infotheory, stats
from chronomotif.functions.canonical import edge_labels, parse
from chronomotif.operators import cliques, communities, graphs, network, nullmodel, shuffles, subgraphs
from chronomotif.plans import motifs
from chronomotif.plans.query import MotifQuery, distribution_median, merged_files
from chronomotif.registry import COMP, EV, FLAT, NAMED, NETS, SETS2, TW, UV, VALID, _modulo, _named, _net, _report, _sets, _with, query
from chronomotif.sources import events as event_files
from chronomotif.sources import nets, reports, tables
from chronomotif.sources.events import user_item_events, user_item_types
from chronomotif.sources.nets import Graph
from chronomotif.storage import saved, shared_dir

COUNTS = "SELECT typed AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm WHERE c2 IS NULL OR c1 = c2 GROUP BY typed"
NODE_TYPE = "CASE WHEN node >= 1000000 THEN 20 ELSE 10 + node % 2 END"


def _file(spark: SparkSession, suffix: str) -> str:
    """A path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}.{suffix}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- readers and writers: what was written and read is what the table says ------


@query(_with(EV, 'SELECT t0 AS start, t0 AS "end", src, dst, etype FROM ev'))
def events_file(spark, sf_dir):
    path = _file(spark, "txt")
    event_files.write_events(user_item_events(spark, sf_dir), path)
    return event_files.read_events(spark, path).drop("event_id")


@query(_with(EV, f"SELECT node, CAST({NODE_TYPE} AS INT) AS ntype FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev)"))
def node_types_file(spark, sf_dir):
    path = _file(spark, "txt")
    user_item_types(user_item_events(spark, sf_dir)).select(F.concat_ws(" ", F.col("node").cast("string"), F.col("ntype").cast("string"))).write.text(path)
    return event_files.read_node_types(spark, path)


@query("SELECT 'event' AS kind, CAST(dense_rank() OVER (ORDER BY event_type) AS INT) AS id, 'the ' || event_type AS name FROM (SELECT DISTINCT event_type FROM events)")
def type_descriptions_file(spark, sf_dir):
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().orderBy("event_type").collect()  # a row for each type
    path = _file(spark, "txt")
    lines = ["#NODES", "20 item", "#EVENTS", *(f'{k + 1} "the {r["event_type"]}"' for k, r in enumerate(kinds))]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return event_files.read_type_descriptions(spark, path).filter("kind = 'event'").select("kind", "id", "name")


@query(_with(NAMED, COUNTS))
def report_file(spark, sf_dir):
    path = _file(spark, "txt")
    events = user_item_events(spark, sf_dir)
    reports.write_report(motifs.find_motifs(events, motifs.MotifSpec(tw=TW, max_size=2), user_item_types(events)), path)
    return reports.read_report(spark, path).select("motif", "count")


@query(_with(NAMED, f"SELECT * FROM ({COUNTS}) WHERE count >= 3"))
def report_file_filtered(spark, sf_dir):
    path = _file(spark, "txt")
    events = user_item_events(spark, sf_dir)
    reports.write_report(motifs.find_motifs(events, motifs.MotifSpec(tw=TW, max_size=2), user_item_types(events)), path)
    return MotifQuery(min_count=3).run(reports.read_report(spark, path)).select("motif", "count")


@query(_with(NAMED, COUNTS))
def report_cache(spark, sf_dir):
    path = _file(spark, "parquet")
    reports.save(_report(spark, sf_dir).select("motif", "count"), path)
    return reports.load(spark, path)


@query(_with(NAMED, f"SELECT count(*) + 1 AS lines FROM ({COUNTS})"))
def report_lines(spark, sf_dir):
    path = _file(spark, "txt")
    events = user_item_events(spark, sf_dir)
    reports.write_report(motifs.find_motifs(events, motifs.MotifSpec(tw=TW, max_size=2), user_item_types(events)), path)
    return spark.createDataFrame([(reports.line_count(spark, path),)], "lines long")


@query(_with(EV, f"SELECT 'nodes' AS section, node || ' ' || {NODE_TYPE} AS value FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev) UNION ALL SELECT DISTINCT 'events', etype || ' kind' FROM ev"))
def sections_file(spark, sf_dir):
    path = _file(spark, "txt")
    events = user_item_events(spark, sf_dir)
    nodes = user_item_types(events).select(F.lit(1).alias("k"), F.concat_ws(" ", F.col("node").cast("string"), F.col("ntype").cast("string")).alias("value"))
    kinds = network.event_types(events).select(F.lit(3).alias("k"), F.concat(F.col("etype").cast("string"), F.lit(" kind")).alias("value"))
    heads = spark.createDataFrame([(0, "#NODES"), (2, "#EVENTS")], "k int, value string")
    heads.unionByName(nodes).unionByName(kinds).orderBy("k", "value").select("value").coalesce(1).write.text(path)
    parts = reports.read_sections(spark, path)
    return parts["nodes"].select(F.lit("nodes").alias("section"), "value").unionByName(parts["events"].select(F.lit("events").alias("section"), "value"))


@query(_with(UV, "SELECT u, v, w FROM g"))
def edg_file(spark, sf_dir):
    path = _file(spark, "edg")
    nets.write_net(_net(spark, sf_dir), path)
    return nets.load_net(spark, path, numeric=True).edges


_INDEX = UV + ", ix AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS n FROM (SELECT DISTINCT u AS node FROM bw))"


@query(_with(_INDEX, "SELECT CAST(least(CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR)) AS VARCHAR) AS u, greatest(CAST(a.n AS VARCHAR), CAST(b.n AS VARCHAR)) AS v, w FROM g JOIN ix a ON a.node = u JOIN ix b ON b.node = v"))
def gml_file(spark, sf_dir):
    path = _file(spark, "gml")
    nets.write_net(_net(spark, sf_dir), path)
    return nets.load_net(spark, path).edges


@query(
    _with(
        _INDEX,
        """SELECT '*Vertices ' || count(*) AS value FROM ix UNION ALL SELECT (n + 1) || ' "' || node || '"' FROM ix UNION ALL SELECT '*Edges'
 UNION ALL SELECT (a.n + 1) || ' ' || (b.n + 1) || ' ' || CAST(w AS VARCHAR) FROM g JOIN ix a ON a.node = u JOIN ix b ON b.node = v""",
    )
)
def pajek_file(spark, sf_dir):
    path = _file(spark, "net")
    nets.write_net(_net(spark, sf_dir), path)
    return spark.read.text(path)


@query(_with(UV, "SELECT u || ' ' || string_agg(CAST(v AS VARCHAR), ' ' ORDER BY CAST(v AS VARCHAR)) AS value FROM bw GROUP BY u"))
def adjacency_file(spark, sf_dir):
    path = _file(spark, "adj")
    nets.write_net(_net(spark, sf_dir), path)
    return spark.read.text(path)


#: Trade between nations, whole: items ordered from one and supplied by the other.
TRADED = """tw AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(count(*) AS DOUBLE) AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""
_NATIONS = TRADED + ", tn AS (SELECT u AS node FROM tw UNION SELECT v FROM tw), ti AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS n FROM tn)"


def _traded(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.filter("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").cast("long").alias("u"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("v")).agg(F.count("*").cast("double").alias("w"))
    return Graph.of(saved(pairs, "traded"))


@query(_with(_NATIONS, "SELECT a.n AS u, b.n AS v, w FROM tw JOIN ti a ON a.node = u JOIN ti b ON b.node = v"))
def matrix_file(spark, sf_dir):
    path = _file(spark, "mat")
    nets.write_net(_traded(spark, sf_dir), path, kind="supperdiag")
    return nets.load_net(spark, path, kind="supperdiag").edges


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def column_file(spark, sf_dir):
    path = _file(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_name", "n_nationkey").coalesce(1).write.csv(path, sep="|", header=True)
    return tables.read_columns(spark, path, columns=["n_nationkey", "n_name", "n_regionkey"], types=["long", "string", "double"], sep="|", header=True)


@query("SELECT CAST(n_nationkey AS BIGINT) AS c0, CAST(n_regionkey AS BIGINT) AS c1 FROM nation")
def data_file(spark, sf_dir):
    path = _file(spark, "txt")
    lines = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("value"), F.lit(1).alias("k"))
    spark.createDataFrame([("a first line", 0)], "value string, k int").unionByName(lines).orderBy("k").select("value").coalesce(1).write.text(path)
    return tables.read_data(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS node_label, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def properties_file(spark, sf_dir):
    path = _file(spark, "tab")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("node_label"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    nets.write_properties(rows, path)
    graph = Graph.of(rows.select(F.col("node_label").alias("u"), F.col("node_label").alias("v"), F.lit(1.0).alias("w")))
    return nets.read_properties(spark, graph, path, missing=False, extra=False).select("node_label", "name", "region")


@query(_with(UV, ", p AS (SELECT CAST(u AS VARCHAR) AS node, u % 5 AS c FROM (SELECT DISTINCT u FROM bw)), r AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS comm FROM p GROUP BY c) SELECT node, comm FROM p JOIN r USING (c)"))
def communities_file(spark, sf_dir):
    path = _file(spark, "txt")
    nets.write_communities(_modulo(_net(spark, sf_dir).nodes, 5), path)
    return nets.read_communities(spark, path)


# --- motifs: options of the search and of the null model -------------------------


def _space(mixed: bool = False, hypothesis: int = 0, omit: float = 0.0) -> str:
    """SQL of the null model over places of up to two edges, under its options."""
    key = {0: "kept", 1: "regexp_replace(typed, ':[0-9]+', ':1', 'g')", 2: "plain"}[hypothesis]
    kinds = "" if mixed else "x.etype = y.etype AND "
    lim = f"""lim AS (SELECT w AS lo, CAST(row_number() OVER (ORDER BY w) - 1 AS INT) AS bin, lead(w) OVER (ORDER BY w) AS hi FROM (SELECT w,
 coalesce(sum(n) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(n) OVER () AS total FROM (SELECT w, count(*) AS n FROM net GROUP BY w)) WHERE above >= floor({omit} * total))"""
    head = NETS[: NETS.index("lim AS (")]
    counted = "" if mixed else " WHERE c2 IS NULL OR c1 = c2"
    return (
        FLAT + head + lim
        + f""", tb AS (SELECT t.*, (SELECT max(bin) FROM lim WHERE lo <= t.w) AS bin FROM tnet t WHERE t.w >= (SELECT min(lo) FROM lim) AND t.w < (SELECT max(lo) + 1 FROM lim)),
sq AS (SELECT src AS s1, dst AS d1, etype AS c1, CAST(NULL AS BIGINT) AS s2, CAST(NULL AS BIGINT) AS d2, CAST(NULL AS INT) AS c2, CAST(bin AS VARCHAR) AS bins FROM tb
 UNION ALL SELECT x.src, x.dst, x.etype, y.src, y.dst, y.etype, x.bin || ',' || y.bin FROM tb x JOIN tb y ON {kinds}(y.src IN (x.src, x.dst) OR y.dst IN (x.src, x.dst))),
sp AS (SELECT sq.*, coalesce(cnt, 0) AS cnt FROM sq LEFT JOIN loc ON sq.s1 = loc.s1 AND sq.d1 = loc.d1 AND sq.c1 = loc.c1
 AND sq.s2 IS NOT DISTINCT FROM loc.s2 AND sq.d2 IS NOT DISTINCT FROM loc.d2 AND sq.c2 IS NOT DISTINCT FROM loc.c2)"""
        + _named("sp", "pn") + _named("loc", "nm")
        + f""", pk AS (SELECT *, {key} AS rk FROM pn), mom AS (SELECT rk, bins, avg(cnt) AS mean, var_pop(cnt) AS var FROM pk GROUP BY rk, bins),
ex AS (SELECT typed, sum(mean) AS ref_avg, sqrt(sum(var)) AS ref_std, count(*) AS n_loc_tot FROM pk JOIN mom USING (rk, bins) GROUP BY typed),
ct AS (SELECT typed, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS n_loc FROM nm{counted} GROUP BY typed)"""
    )


_EXPECTED = "SELECT typed AS motif, coalesce(count, 0) AS count, round(ref_avg, 6) AS ref_avg, round(ref_std, 6) AS ref_std, n_loc_tot FROM ex FULL JOIN ct USING (typed)"


def _expected(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    events = user_item_events(spark, sf_dir)
    out = motifs.find_motifs(events, motifs.MotifSpec(tw=TW, max_size=2, references=0, **options), user_item_types(events))
    return out.select("motif", "count", F.round("ref_avg", 6).alias("ref_avg"), F.round("ref_std", 6).alias("ref_std"), "n_loc_tot")


@query(_with(_space(hypothesis=1), _EXPECTED))
def motif_report_event_types(spark, sf_dir):
    return _expected(spark, sf_dir, hypothesis=1)


@query(_with(_space(hypothesis=2), _EXPECTED))
def motif_report_all_types(spark, sf_dir):
    return _expected(spark, sf_dir, hypothesis=2)


@query(_with(_space(mixed=True), _EXPECTED))
def motif_report_mixed(spark, sf_dir):
    return _expected(spark, sf_dir, allow_multiple_event_types=True)


@query(_with(_space(omit=0.02), _EXPECTED))
def motif_report_light(spark, sf_dir):
    return _expected(spark, sf_dir, weight_omit=0.02)


@query(
    _with(
        NAMED.replace("sets AS (SELECT", "root_ok AS (SELECT event_id AS root FROM ev WHERE t0 BETWEEN (SELECT arg_min(t0, event_id) FROM ev) + 86400 AND (SELECT arg_max(t0, event_id) FROM ev) - 86400),\nsets AS (SELECT", 1)
        .replace("event_id AS root, event_id FROM ev\n", "event_id AS root, event_id FROM ev WHERE event_id IN (SELECT root FROM root_ok)\n")
        .replace("unnest([a, b]) FROM adj)", "unnest([a, b]) FROM adj WHERE a IN (SELECT root FROM root_ok))"),
        COUNTS,
    )
)
def motifs_in_window(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    return motifs.find_motifs(events, motifs.MotifSpec(tw=TW, max_size=2, time_gap=86400), user_item_types(events)).select("motif", "count")


@query(_with(NAMED, "SELECT typed AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm GROUP BY typed"))
def motifs_of_mixed_types(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    return motifs.find_motifs(events, motifs.MotifSpec(tw=TW, max_size=2, allow_multiple_event_types=True), user_item_types(events)).select("motif", "count")


_MAXIMAL = (
    SETS2.replace("UNION ALL SELECT a || ',' || b, a, unnest([a, b]) FROM adj)", "WHERE false)")
    + """, ok AS (SELECT comp FROM (SELECT comp, node, max(place) - min(place) + 1 = count(*) AS ok FROM comp JOIN pl USING (event_id) GROUP BY comp, node) GROUP BY comp HAVING bool_and(ok)),
mx AS (SELECT comp, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM comp JOIN ok USING (comp) GROUP BY comp)"""
)


@query(_with(_MAXIMAL, "SELECT ids FROM mx"))
def maximal_motifs_whole(spark, sf_dir):
    sets = motifs.find_sets(user_item_events(spark, sf_dir), motifs.MotifSpec(tw=TW, maximal=True))
    return sets.select(subgraphs.ids_text().alias("ids"))


@query(_with(NAMED, f"SELECT grp, motif, count, place FROM (SELECT plain AS grp, motif, count, row_number() OVER (PARTITION BY plain ORDER BY count DESC, motif) AS place FROM ({COUNTS.replace('typed AS motif', 'plain, typed AS motif').replace('GROUP BY typed', 'GROUP BY plain, typed')})) WHERE place <= 2"))
def motif_top_two(spark, sf_dir):
    out = MotifQuery(group_by="motif", top=2).run(_report(spark, sf_dir))
    return out.select("grp", "motif", "count", F.col("place").cast("long").alias("place"))


@query(_with(NAMED, f"SELECT motif, count, source_file FROM ({COUNTS}), (SELECT unnest(['one', 'two']) AS source_file)"))
def merged_reports(spark, sf_dir):
    report = saved(_report(spark, sf_dir).select("motif", "count"), "report")
    return merged_files([("one", report), ("two", report)])


_AGAINST = NAMED + f", a AS ({COUNTS}), b AS (SELECT motif, 2 * count AS ref FROM a WHERE count >= 3)"


@query(_with(_AGAINST, "SELECT motif, count, coalesce(ref, 0) AS ref, round(CASE WHEN ref > 0 THEN count / ref ELSE -1.0 END, 9) AS ratio FROM a LEFT JOIN b USING (motif)"))
def single_reference_report(spark, sf_dir):
    report = saved(_report(spark, sf_dir).select("motif", "count"), "report")
    out = motifs.single_reference(report, report.filter("count >= 3").select("motif", (2 * F.col("count")).alias("count")))
    return out.withColumn("ratio", F.round("ratio", 9))


_GAPS = FLAT.replace("fl AS (SELECT x.src", "gp AS (SELECT ids, e1, e2, CASE WHEN e2 IS NULL THEN 0 ELSE (SELECT gap FROM adj WHERE a = e1 AND b = e2) END AS gap FROM vs),\nfl AS (SELECT gap, x.src", 1).replace(
    "FROM vs JOIN ev x", "FROM gp JOIN ev x", 1
).replace("loc AS (SELECT s1,", "loc AS (SELECT gap, s1,", 1)


@query(_with(_GAPS + _named("loc", "nm"), "SELECT typed AS motif, string_agg(gap || ':' || n, ' ' ORDER BY gap) AS counts FROM (SELECT typed, gap, CAST(sum(cnt) AS BIGINT) AS n FROM nm GROUP BY typed, gap) GROUP BY typed"))
def gap_distribution_report(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    out = motifs.gap_distribution(motifs.find_sets(events, motifs.MotifSpec(tw=TW, max_size=2)), user_item_types(events))
    one = lambda x: F.concat_ws(":", x["gap"].cast("string"), x["n"].cast("string"))
    return out.select("motif", F.array_join(F.transform("counts", one), " ").alias("counts"))


@query(
    _with(
        SETS2 + VALID + ", vs AS (SELECT ids, min(event_id) AS e1, max(event_id) AS e2 FROM sets JOIN valid USING (ids) GROUP BY ids)",
        """SELECT ids, array_to_string(list_sort(list_distinct([x.src, x.dst, y.src, y.dst])), ',') AS nodes,
 array_to_string(list_sort(list_distinct([x.src || '-' || x.dst || ':' || x.etype, y.src || '-' || y.dst || ':' || y.etype])), ',') AS edges FROM vs JOIN ev x ON x.event_id = e1 JOIN ev y ON y.event_id = e2""",
    )
)
def subgraph_parts(spark, sf_dir):
    sets = _sets(user_item_events(spark, sf_dir), 2)[2]
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    edge = lambda e: F.concat(e["src"].cast("string"), F.lit("-"), e["dst"].cast("string"), F.lit(":"), e["etype"].cast("string"))
    edges = F.transform(subgraphs.undirected_edges_of(), edge)
    return sets.select(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), text(subgraphs.nodes_of()).alias("nodes"), text(edges).alias("edges"))


@query(_with(NAMED, """SELECT DISTINCT typed AS motif, CASE WHEN s2 IS NULL THEN '0>1:1' WHEN i2 = 0 AND j2 = 1 THEN '0>1:1,2' ELSE '0>1:1 ' || i2 || '>' || j2 || ':2' END AS labels FROM nm WHERE c2 IS NULL OR c1 = c2"""))
def motif_edge_labels(spark, sf_dir):
    out = _report(spark, sf_dir)
    return out.select("motif", F.array_join(edge_labels(parse(F.col("motif"))[1]), " ").alias("labels"))


@query(_with(EV, "SELECT DISTINCT etype FROM ev"))
def event_types(spark, sf_dir):
    return network.event_types(user_item_events(spark, sf_dir))


@query(
    _with(
        EV,
        """, d AS (SELECT w, count(*) AS n FROM (SELECT count(*) AS w FROM ev GROUP BY src, dst) GROUP BY w), r AS (SELECT *, floor((sum(n) OVER (ORDER BY w) - n) / 500.0) AS k FROM d),
b AS (SELECT min(w) AS lo, max(w) AS top FROM r GROUP BY k) SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS INT) AS bin, lo, coalesce(lead(lo) OVER (ORDER BY lo), top + 1) AS hi FROM b""",
    )
)
def bins_by_count(spark, sf_dir):
    dist = network.weight_distribution(network.aggregate_net(user_item_events(spark, sf_dir)))
    return nullmodel.binned_by_count(dist, 500)


# --- shuffles: permutations by a seeded hash, chains by what they leave as it is --


def _u(seed: int, *cols: str) -> str:
    return f"('0x' || substr(md5('{seed}#' || {' || chr(35) || '.join(cols)}), 1, 8))::BIGINT / 4294967296.0"


@query(
    _with(
        EV,
        f""", nt AS (SELECT node, CAST({NODE_TYPE} AS INT) AS ntype FROM (SELECT src AS node FROM ev UNION SELECT dst FROM ev)),
l AS (SELECT node, row_number() OVER (ORDER BY node) AS n FROM nt), r AS (SELECT ntype, row_number() OVER (ORDER BY {_u(4, 'node')}, node) AS n FROM nt) SELECT node, ntype FROM l JOIN r USING (n)""",
    )
)
def shuffled_node_types(spark, sf_dir):
    return shuffles.shuffle_node_types(user_item_types(user_item_events(spark, sf_dir)), 4)


@query(
    _with(
        EV,
        f""", ed AS (SELECT DISTINCT src, dst, CAST(1 + (31 * src + dst) % 4 AS INT) AS k FROM ev), l AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS n FROM ed),
r AS (SELECT k, row_number() OVER (ORDER BY {_u(4, 'src', 'dst')}, src, dst) AS n FROM ed) SELECT event_id, src, dst, k AS etype FROM ev JOIN l USING (src, dst) JOIN r USING (n)""",
    )
)
def shuffled_edge_types(spark, sf_dir):
    events = user_item_events(spark, sf_dir).withColumn("etype", (1 + (31 * F.col("src") + F.col("dst")) % 4).cast("int"))
    return shuffles.shuffle_edge_types(events, 4).select("event_id", "src", "dst", "etype")


@query(_with(EV, f", l AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM ev), r AS (SELECT etype, row_number() OVER (ORDER BY {_u(4, 'event_id')}, event_id) AS n FROM ev) SELECT event_id, etype FROM l JOIN r USING (n)"))
def shuffled_event_types(spark, sf_dir):
    return shuffles.shuffle_event_types(user_item_events(spark, sf_dir), 4).select("event_id", "etype")


_KEPT = 'SELECT etype, t0 AS at, src, dst, count(*) AS n FROM ev GROUP BY GROUPING SETS ((etype, t0), (etype, src, dst))'


def _kept(events: DataFrame) -> DataFrame:
    """What a shuffle of times leaves: the times of each type, and the edges of each type."""
    times = events.groupBy("etype", F.col("start").alias("at")).agg(F.count("*").alias("n"))
    edges = events.groupBy("etype", "src", "dst").agg(F.count("*").alias("n"))
    return times.unionByName(edges, allowMissingColumns=True).select("etype", "at", "src", "dst", "n")


@query(_with(EV, _KEPT))
def constrained_shuffle_kept(spark, sf_dir):
    return _kept(shuffles.constrained_time_shuffle(user_item_events(spark, sf_dir), 5))


@query(_with(EV, _KEPT))
def biased_shuffle_kept(spark, sf_dir):
    return _kept(shuffles.biased_time_shuffle(user_item_events(spark, sf_dir), 3, 5))


@query(_with(EV, ", ne AS (SELECT src AS node, * FROM ev UNION ALL SELECT dst, * FROM ev) SELECT node, a, b FROM (SELECT node, event_id AS a, t0, lead(event_id) OVER w AS b, lead(t0) OVER w AS bt FROM ne WINDOW w AS (PARTITION BY node ORDER BY t0, event_id)) WHERE t0 >= bt"))
def overlapping_events(spark, sf_dir):
    return shuffles.overlapping(user_item_events(spark, sf_dir))


@query(_with(EV, "SELECT event_id, 'out of order' AS fault FROM (SELECT event_id, t0, lag(t0) OVER (ORDER BY event_id) AS before FROM ev) WHERE before > t0"))
def event_faults(spark, sf_dir):
    return shuffles.faults(user_item_events(spark, sf_dir))


@query(_with(UV, "SELECT u AS node, count(DISTINCT v) AS degree FROM bw GROUP BY u"))
def rewired_degrees(spark, sf_dir):
    g = _net(spark, sf_dir)
    return graphs.degrees(Graph(saved(shuffles.configuration_model(g.edges, 6), "rewired"), g.nodes)).select("node", "degree")


# --- networks --------------------------------------------------------------------


@query(_with(UV, "SELECT w FROM g"))
def edge_weights(spark, sf_dir):
    return graphs.weights(_net(spark, sf_dir))


@query(_with(UV, "SELECT u, v, round(1 - w / (SELECT max(w) FROM g) + 0.001, 9) AS w FROM g"))
def weights_of_distances(spark, sf_dir):
    return graphs.distances_to_weights(_net(spark, sf_dir)).edges.withColumn("w", F.round("w", 9))


@query(_with(_INDEX, "SELECT a.n AS u, b.n AS v, w FROM g JOIN ix a ON a.node = u JOIN ix b ON b.node = v"))
def reindexed_net(spark, sf_dir):
    return graphs.reindexed(_net(spark, sf_dir))[0].edges


@query(_with(UV, "SELECT u, v, CASE WHEN w >= 2 THEN 10 * w ELSE w END AS w FROM g"))
def united_nets(spark, sf_dir):
    g = _net(spark, sf_dir)
    return graphs.union(g, Graph(g.edges.filter("w >= 2").withColumn("w", 10 * F.col("w")), g.nodes)).edges


@query("SELECT a.n_nationkey AS u, b.n_nationkey AS v, 1.0::DOUBLE AS w FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def complete_net(spark, sf_dir):
    return graphs.complete(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("node"))).edges


@query("SELECT n_nationkey, round(CASE WHEN lo = hi THEN 5.5 ELSE 1 + 9 * (n_regionkey - lo) / (hi - lo)::DOUBLE END, 9) AS scaled FROM nation, (SELECT min(n_regionkey) AS lo, max(n_regionkey) AS hi FROM nation)")
def scaled_values(spark, sf_dir):
    out = graphs.scaled(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey"), "n_regionkey", 1.0, 10.0)
    return out.select("n_nationkey", F.round("scaled", 9).alias("scaled"))


@query("SELECT unnest(['n_nationkey', 'n_regionkey']) AS name")
def numeric_properties(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_regionkey").cast("string").alias("n_regionkey"), "n_name")
    return spark.createDataFrame([(c,) for c in graphs.numeric_columns(rows)], "name string")


_TRIS = TRADED + ", tri AS (SELECT a.u AS a, a.v AS b, b.v AS c FROM tw a JOIN tw b ON a.v = b.u JOIN tw x ON x.u = a.u AND x.v = b.v), inc AS (SELECT a || ',' || b || ',' || c AS clique, unnest([a || ',' || b, a || ',' || c, b || ',' || c]) AS sub FROM tri)"


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(_with(_TRIS, "SELECT DISTINCT a || ',' || b || ',' || c AS clique FROM tri"))
def triangles_whole(spark, sf_dir):
    return cliques.k_cliques(_traded(spark, sf_dir), 3).select(_text("clique").alias("clique"))


@query(_with(_TRIS, "SELECT clique, sub FROM inc"))
def clique_subcliques(spark, sf_dir):
    return cliques.clique_incidence(cliques.k_cliques(_traded(spark, sf_dir), 3)).select(_text("clique").alias("clique"), _text("sub").alias("sub"))


@query(_with(_TRIS, "SELECT DISTINCT least(x.clique, y.clique) AS a, greatest(x.clique, y.clique) AS b FROM inc x JOIN inc y ON x.sub = y.sub AND x.clique < y.clique"))
def clique_neighbours(spark, sf_dir):
    out = cliques.clique_network(cliques.k_cliques(_traded(spark, sf_dir), 3)).select(_text("a").alias("a"), _text("b").alias("b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_STRONG = _TRIS + """, q AS (SELECT median(w) AS q FROM tw), iw AS (SELECT a || ',' || b || ',' || tri.c AS clique, least(x.w, y.w, z.w) AS least FROM tri JOIN tw x ON x.u = a AND x.v = b JOIN tw y ON y.u = a AND y.v = tri.c JOIN tw z ON z.u = b AND z.v = tri.c),
si AS (SELECT inc.* FROM inc JOIN iw USING (clique), q WHERE least >= q), tt AS (SELECT DISTINCT x.clique AS p, y.clique AS q FROM si x JOIN si y ON x.sub = y.sub),
z(t, c) AS (SELECT DISTINCT clique, clique FROM si UNION SELECT tt.q, z.c FROM z JOIN tt ON tt.p = z.t WHERE z.c < tt.q), cc AS (SELECT t, min(c) AS c FROM z GROUP BY t),
mm AS (SELECT DISTINCT c, CAST(unnest(string_split(t, ',')) AS BIGINT) AS node FROM cc)"""


@query(_with(_STRONG, "SELECT node, comm FROM mm JOIN (SELECT c, row_number() OVER (ORDER BY count(*) DESC, min(node), c) - 1 AS comm FROM mm GROUP BY c) USING (c)"))
def clique_percolation(spark, sf_dir):
    g = _traded(spark, sf_dir)
    middle = g.edges.agg(F.percentile("w", F.lit(0.5))).first()[0]
    return cliques.clique_percolation(g, 3, [middle], weight="least").select("node", "comm")



_CUT = UV + """, bd AS (SELECT unnest([2.0, 3.0]) AS bound), p(bound, node, c) AS (SELECT bound, u, u FROM bd, (SELECT DISTINCT u FROM bw) UNION SELECT p.bound, bw.v, p.c FROM p JOIN bw ON bw.u = p.node AND bw.w >= p.bound WHERE p.c < bw.v),
l AS (SELECT bound, node, min(c) AS c FROM p GROUP BY bound, node), k AS (SELECT bound, c, row_number() OVER (PARTITION BY bound ORDER BY count(*) DESC, min(node)) - 1 AS comm FROM l GROUP BY bound, c)"""


@query(_with(_CUT, "SELECT CAST(bound AS DOUBLE) AS bound, node, comm FROM l JOIN k USING (bound, c)"))
def edge_percolation(spark, sf_dir):
    return cliques.edge_percolation(_net(spark, sf_dir), [2.0, 3.0], reverse=True)


_WHOLE = UV + ", p(node, c) AS (SELECT DISTINCT u, u FROM bw UNION SELECT bw.v, p.c FROM p JOIN bw ON bw.u = p.node WHERE p.c < bw.v), pt AS (SELECT node, min(c) AS c FROM p GROUP BY node), sz AS (SELECT c, count(*) AS size FROM pt GROUP BY c)"


@query(_with(_WHOLE, "SELECT size, count(*) AS n FROM sz GROUP BY size"))
def component_sizes_whole(spark, sf_dir):
    return communities.size_distribution(cliques.component_communities(_net(spark, sf_dir)))


# --- communities and distributions ------------------------------------------------

_FIVE = UV + ", nd AS (SELECT DISTINCT u AS node FROM bw), a AS (SELECT node, node % 5 AS c FROM nd), b AS (SELECT node, node % 7 AS c FROM nd), sa AS (SELECT c, count(*) AS size FROM a GROUP BY c), sb AS (SELECT c, count(*) AS size FROM b GROUP BY c)"


def _five(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame, DataFrame]:
    g = _net(spark, sf_dir)
    return g, _modulo(g.nodes, 5), _modulo(g.nodes, 7)


@query(_with(_FIVE, ", t AS (SELECT max(size) AS m FROM sa) SELECT round(coalesce(sum(size * size) / sum(size), 0), 6) AS susceptibility FROM sa, t WHERE size < m"))
def susceptibility_all_giants(spark, sf_dir):
    return communities.susceptibility(_five(spark, sf_dir)[1], all_giants=True).select(F.round("susceptibility", 6).alias("susceptibility"))


@query(_with(_FIVE, "SELECT round(sum(size) * sum(size) / sum(size * size), 9) AS chi FROM (SELECT size, row_number() OVER (ORDER BY size DESC, c) AS k FROM sa) WHERE k > 1"))
def chi_of_sizes(spark, sf_dir):
    return communities.chi(_five(spark, sf_dir)[1]).select(F.round("chi", 9).alias("chi"))


@query(_with(_FIVE, "SELECT max(size) AS size FROM sa"))
def giant_size(spark, sf_dir):
    return communities.giant(_five(spark, sf_dir)[1])


@query(_with(_FIVE, "SELECT node, array_to_string(list_sort([a.c, 10 + b.c]), ',') AS comms FROM a JOIN b USING (node)"))
def community_lists(spark, sf_dir):
    _, a, b = _five(spark, sf_dir)
    both = a.unionByName(b.withColumn("comm", 10 + F.col("comm")))
    return communities.memberships(both).select("node", _text("comms").alias("comms"))


@query(_with(_FIVE, "SELECT node, c AS comm FROM a WHERE node % 3 = 0"))
def communities_of_some(spark, sf_dir):
    g, a, _ = _five(spark, sf_dir)
    return communities.restricted(a, g.nodes.filter("node % 3 = 0"))


@query(_with(_FIVE, """, s AS (SELECT u AS node, sum(w) AS s, u % 5 AS c FROM bw GROUP BY u), t AS (SELECT 2 * sum(w) AS w2 FROM g), p AS (SELECT c, sum(s) * sum(s) - sum(s * s) AS x FROM s GROUP BY c)
SELECT round((SELECT sum(w) FROM g WHERE u % 5 = v % 5) / w2 - (SELECT sum(x) FROM p) / 2 / w2 / w2, 9) AS modularity FROM t"""))
def modularity_of_pairs(spark, sf_dir):
    g, a, _ = _five(spark, sf_dir)
    return communities.modularity(g, a, "reference").select(F.round("modularity", 9).alias("modularity"))


@query(_with(_FIVE, "SELECT size, round(avg(w), 9) AS weight FROM g JOIN sa ON sa.c = u % 5 WHERE u % 5 = v % 5 GROUP BY size"))
def weight_by_community_size(spark, sf_dir):
    g, a, _ = _five(spark, sf_dir)
    return communities.average_weight_by_size(g, a).select("size", F.round("weight", 9).alias("weight"))


@query(_with(_FIVE, """, big AS (SELECT node, node % 35 AS c FROM nd), ov AS (SELECT a.c AS a, big.c AS b, count(*) AS n FROM a JOIN big USING (node) GROUP BY 1, 2), s3 AS (SELECT c, count(*) AS nb FROM big GROUP BY c)
SELECT sa.c AS comm, round(coalesce(sum(CASE WHEN n < nb THEN n ELSE 0 END), 0) / any_value(size), 9) AS imperfection, coalesce(sum(CASE WHEN n < nb THEN n ELSE 0 END), 0) = 0 AS perfect FROM sa LEFT JOIN ov ON ov.a = sa.c LEFT JOIN s3 ON s3.c = ov.b GROUP BY sa.c
UNION ALL SELECT 100 + sb.c, round(coalesce(sum(CASE WHEN n < nb THEN n ELSE 0 END), 0) / any_value(sb.size), 9), coalesce(sum(CASE WHEN n < nb THEN n ELSE 0 END), 0) = 0
 FROM sb LEFT JOIN (SELECT b.c AS b, a.c AS a, count(*) AS n FROM a JOIN b USING (node) GROUP BY 1, 2) o ON o.b = sb.c LEFT JOIN (SELECT c, size AS nb FROM sa) x ON x.c = o.a GROUP BY sb.c"""))
def tiling(spark, sf_dir):
    g, a, b = _five(spark, sf_dir)
    fine = communities.tiling_imperfection(a, _modulo(g.nodes, 35))
    torn = communities.tiling_imperfection(b, a).withColumn("comm", 100 + F.col("comm"))
    return fine.unionByName(torn).select("comm", F.round("imperfection", 9).alias("imperfection"), "perfect")


_H = lambda x: f"(CASE WHEN {x} > 0 THEN -({x} / t) * log2({x} / t) ELSE 0 END)"


def _one_way(x: str, y: str, sx: str, sy: str) -> str:
    """SQL of the mean, over communities of ``x``, of the least conditional entropy."""
    same, differ = f"{_H('n')} + {_H('(t - na - nb + n)')}", f"{_H('(na - n)')} + {_H('(nb - n)')}"
    return f"""SELECT avg(CASE WHEN own > 0 THEN coalesce(best, own) / own ELSE 0 END) AS v FROM (SELECT s.c, any_value({_H('s.size')} + {_H('(t - s.size)')}) AS own,
 min(CASE WHEN {same} > {differ} THEN {same} + {differ} - {_H('nb')} - {_H('(t - nb)')} END) AS best FROM {sx} s JOIN (SELECT {x}.c AS a, {y}.c AS b, CAST(count(*) AS DOUBLE) AS n FROM {x} JOIN {y} USING (node) GROUP BY 1, 2) o ON o.a = s.c
 JOIN (SELECT c, CAST(size AS DOUBLE) AS na FROM {sx}) ka ON ka.c = o.a JOIN (SELECT c, CAST(size AS DOUBLE) AS nb FROM {sy}) kb ON kb.c = o.b, (SELECT CAST(count(*) AS DOUBLE) AS t FROM nd) tt GROUP BY s.c)"""


@query(_with(_FIVE, f", big AS (SELECT node, node % 35 AS c FROM nd), s3 AS (SELECT c, count(*) AS size FROM big GROUP BY c) SELECT round(avg(v), 9) AS variation FROM ({_one_way('a', 'big', 'sa', 's3')} UNION ALL {_one_way('big', 'a', 's3', 'sa')})"))
def variation_of_information(spark, sf_dir):
    g, a, _ = _five(spark, sf_dir)
    return communities.variation_of_information(a, _modulo(g.nodes, 35), g.nodes.count()).select(F.round("variation", 9).alias("variation"))


@query(_with(_FIVE, "SELECT 0 AS level, 0::BIGINT AS comm, CAST(NULL AS BIGINT) AS parent UNION ALL SELECT 1, c, 0 FROM sa UNION ALL SELECT DISTINCT 2, node % 35, node % 5 FROM nd"))
def community_hierarchy(spark, sf_dir):
    g, a, _ = _five(spark, sf_dir)
    return communities.hierarchy([_modulo(g.nodes, 1), a, _modulo(g.nodes, 35)])


_EVENTS = "WITH p AS (SELECT event_type AS x, user_id % 10 AS y, dayofweek(ts) AS z, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY ALL)"


def _joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.select(F.col("event_type").alias("x"), (F.col("user_id") % 10).alias("y"), (F.dayofweek("ts") - 1).alias("z"))
    return saved(infotheory.probabilities(events, ["x", "y", "z"]), "joint")


_HZ = "(SELECT -sum(p * log2(p)) FROM (SELECT sum(p) AS p FROM p GROUP BY {}))"


@query(f"{_EVENTS} SELECT round({_HZ.format('x, y, z')} - {_HZ.format('z')}, 9) AS entropy")
def conditional_pair_entropy(spark, sf_dir):
    return infotheory.conditional_entropy(_joint(spark, sf_dir), ["z"]).select(F.round("entropy", 9).alias("entropy"))


@query(f"{_EVENTS} SELECT round({_HZ.format('x, z')} + {_HZ.format('y, z')} - {_HZ.format('x, y, z')} - {_HZ.format('z')}, 9) AS information")
def conditional_information(spark, sf_dir):
    return infotheory.conditional_mutual_information(_joint(spark, sf_dir), ["x"], ["y"], ["z"]).select(F.round("information", 9).alias("information"))


@query(f"{_EVENTS} SELECT round(-sum(p * log2(p)) / log2(count(*)), 9) AS entropy FROM p")
def normalised_entropy(spark, sf_dir):
    return infotheory.normalised_entropy(_joint(spark, sf_dir)).select(F.round("entropy", 9).alias("entropy"))


@query("SELECT round(avg(abs(a.n_regionkey - b.n_regionkey)), 9) AS mean FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey")
def mean_distance(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("x"))
    return stats.mean_pairwise(rows, F.abs(F.col("a_x") - F.col("b_x"))).select(F.round("mean", 9).alias("mean"))


@query("SELECT p_brand, min(k) AS median FROM (SELECT p_brand, k, sum(n) OVER (PARTITION BY p_brand ORDER BY k) / sum(n) OVER (PARTITION BY p_brand) AS upto FROM (SELECT p_brand, p_size - 1 AS k, count(*) AS n FROM part GROUP BY ALL)) WHERE upto >= 0.5 - 1e-12 GROUP BY p_brand")
def distribution_medians(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    rows = n.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_size", "n"))).alias("m"), F.sum("n").alias("total"), F.max("p_size").alias("most"))
    shares = F.transform(F.sequence(F.lit(1), F.col("most").cast("int")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("total"))
    return distribution_median(rows.withColumn("d", shares), "d").select("p_brand", "median")
