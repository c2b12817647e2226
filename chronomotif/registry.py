"""Queries of the temporal-network engine over the test tables, with SQL to compare.

Events are the ``events`` table as a network from users to items, in seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.functions import infotheory, stats
from chronomotif.functions.canonical import parse, roles
from chronomotif.operators import adjacency, cliques, communities, components, graphs, network, nullmodel, shuffles, subgraphs
from chronomotif.plans import motifs
from chronomotif.plans.query import MotifQuery, chart_labels, with_levels
from chronomotif.sources.events import user_item_events, user_item_types
from chronomotif.sources.nets import Graph
from chronomotif.storage import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TW = 1800
SPEC = motifs.MotifSpec(tw=TW, max_size=2)


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- shared SQL -----------------------------------------------------------

EV = """ev AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t0, user_id AS src,
 1000000 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS dst, CAST(dense_rank() OVER (ORDER BY event_type) AS INT) AS etype FROM events)"""
ADJ = (
    EV
    + """, ne AS (SELECT src AS node, * FROM ev UNION ALL SELECT dst AS node, * FROM ev),
ld AS (SELECT node, event_id AS a, t0, src, dst, lead(event_id) OVER w AS b, lead(t0) OVER w AS bt, lead(src) OVER w AS bs, lead(dst) OVER w AS bd
 FROM ne WINDOW w AS (PARTITION BY node ORDER BY event_id)),
adj0 AS (SELECT a, b, count(*) AS n, min(bt - t0) AS gap, bool_or(least(src, dst) = least(bs, bd) AND greatest(src, dst) = greatest(bs, bd)) AS same
 FROM ld WHERE b IS NOT NULL GROUP BY a, b),
adjall AS (SELECT a, b, gap FROM adj0 WHERE n = 2 OR NOT same),
adj AS (SELECT a, b, gap FROM adjall WHERE gap BETWEEN 0 AND 1800)"""
)
COMP = (
    ADJ
    + """, und AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj),
r(id, c) AS (SELECT event_id, event_id FROM ev UNION SELECT u.b, r.c FROM r JOIN und u ON u.a = r.id WHERE r.c < u.b),
comp AS (SELECT id AS event_id, min(c) AS comp FROM r GROUP BY id)"""
)
PLACES = COMP + ", pl AS (SELECT node, event_id, row_number() OVER (PARTITION BY node, comp ORDER BY event_id) AS place FROM ne JOIN comp USING (event_id))"
SETS2 = (
    PLACES
    + """, sets AS (SELECT CAST(event_id AS VARCHAR) AS ids, event_id AS root, event_id FROM ev
 UNION ALL SELECT a || ',' || b, a, unnest([a, b]) FROM adj)"""
)
SETS3 = (
    PLACES
    + """, trip AS (SELECT DISTINCT a.a AS root, list_sort([a.a, a.b, u.b]) AS l FROM adj a JOIN und u ON u.a IN (a.a, a.b) WHERE u.b > a.a AND u.b <> a.b
 UNION SELECT DISTINCT LEAST(a.a, u.b), list_sort([a.a, a.b, u.b]) FROM adj a JOIN und u ON u.a IN (a.a, a.b) WHERE u.b <> a.a AND u.b <> a.b),
t3 AS (SELECT DISTINCT l FROM trip),
sets AS (SELECT CAST(event_id AS VARCHAR) AS ids, event_id FROM ev UNION ALL SELECT a || ',' || b, unnest([a, b]) FROM adj
 UNION ALL SELECT l[1] || ',' || l[2] || ',' || l[3], unnest(l) FROM t3)"""
)
VALID = """, valid AS (SELECT ids FROM (SELECT ids, node, max(place) - min(place) + 1 = count(*) AS ok FROM sets JOIN pl USING (event_id) GROUP BY ids, node)
 GROUP BY ids HAVING bool_and(ok))"""
#: Valid sets of one or two events, the second's columns null for one.
FLAT = (
    SETS2
    + VALID
    + """, vs AS (SELECT ids, min(event_id) AS e1, CASE WHEN count(*) = 2 THEN max(event_id) END AS e2 FROM sets JOIN valid USING (ids) GROUP BY ids),
fl AS (SELECT x.src AS s1, x.dst AS d1, x.etype AS c1, y.src AS s2, y.dst AS d2, y.etype AS c2 FROM vs JOIN ev x ON x.event_id = e1 LEFT JOIN ev y ON y.event_id = e2),
loc AS (SELECT s1, d1, c1, s2, d2, c2, count(*) AS cnt FROM fl GROUP BY ALL)"""
)


def _named(rows: str, out: str) -> str:
    """SQL that adds labels and keys of ``rows`` (s1 .. c2): ``typed`` and ``plain``."""
    nt = lambda x: f"(CASE WHEN {x} >= 1000000 THEN 20 ELSE 10 + {x} % 2 END)"
    return f""", {out}0 AS (SELECT *, CASE s2 WHEN s1 THEN 0 WHEN d1 THEN 1 ELSE 2 END AS i2,
 CASE WHEN d2 = s1 THEN 0 WHEN d2 = d1 THEN 1 WHEN s2 IN (s1, d1) THEN 2 ELSE 3 END AS j2 FROM {rows}),
{out} AS (SELECT *, '[' || {nt('s1')} || ',' || {nt('d1')} || CASE WHEN s2 IS NOT NULL AND i2 = 2 THEN ',' || {nt('s2')} ELSE '' END
 || CASE WHEN s2 IS NOT NULL AND j2 >= 2 THEN ',' || {nt('d2')} ELSE '' END || '] 0>1:' || c1 || CASE WHEN s2 IS NULL THEN '' ELSE ' ' || i2 || '>' || j2 || ':' || c2 END AS typed,
 '[0,0' || CASE WHEN s2 IS NOT NULL AND i2 = 2 THEN ',0' ELSE '' END || CASE WHEN s2 IS NOT NULL AND j2 >= 2 THEN ',0' ELSE '' END || '] 0>1:1'
 || CASE WHEN s2 IS NULL THEN '' ELSE ' ' || i2 || '>' || j2 || ':1' END AS plain,
 '[0,0' || CASE WHEN s2 IS NOT NULL AND i2 = 2 THEN ',0' ELSE '' END || CASE WHEN s2 IS NOT NULL AND j2 >= 2 THEN ',0' ELSE '' END || '] 0>1:' || c1
 || CASE WHEN s2 IS NULL THEN '' ELSE ' ' || i2 || '>' || j2 || ':' || c2 END AS kept FROM {out}0)"""


NAMED = FLAT + _named("loc", "nm")
NETS = """, net AS (SELECT src, dst, count(*) AS w FROM ev GROUP BY src, dst), tnet AS (SELECT src, dst, etype, count(*) AS w FROM ev GROUP BY src, dst, etype),
lim AS (SELECT w AS lo, CAST(row_number() OVER (ORDER BY w) - 1 AS INT) AS bin FROM (SELECT DISTINCT w FROM net)),
tb AS (SELECT t.*, (SELECT max(bin) FROM lim WHERE lo <= t.w) AS bin FROM tnet t WHERE t.w >= (SELECT min(w) FROM net) AND t.w <= (SELECT max(w) FROM net))"""
SPACE = (
    FLAT
    + NETS
    + """, sq AS (SELECT src AS s1, dst AS d1, etype AS c1, CAST(NULL AS BIGINT) AS s2, CAST(NULL AS BIGINT) AS d2, CAST(NULL AS INT) AS c2, CAST(bin AS VARCHAR) AS bins FROM tb
 UNION ALL SELECT x.src, x.dst, x.etype, y.src, y.dst, y.etype, x.bin || ',' || y.bin FROM tb x JOIN tb y
 ON x.etype = y.etype AND (y.src IN (x.src, x.dst) OR y.dst IN (x.src, x.dst))),
sp AS (SELECT sq.*, coalesce(cnt, 0) AS cnt FROM sq LEFT JOIN loc ON sq.s1 = loc.s1 AND sq.d1 = loc.d1 AND sq.c1 = loc.c1
 AND sq.s2 IS NOT DISTINCT FROM loc.s2 AND sq.d2 IS NOT DISTINCT FROM loc.d2 AND sq.c2 IS NOT DISTINCT FROM loc.c2)"""
    + _named("sp", "pn")
    + """, mom AS (SELECT kept, bins, count(*) AS total, avg(cnt) AS mean, var_pop(cnt) AS var FROM pn GROUP BY kept, bins),
ex AS (SELECT typed, sum(mean) AS ref_avg, sqrt(sum(var)) AS ref_std, count(*) AS n_loc_tot, count(*) FILTER (cnt > 0) AS n_loc FROM pn JOIN mom USING (kept, bins) GROUP BY typed)"""
)


def _with(prelude: str, body: str) -> str:
    return f"WITH RECURSIVE {prelude} {body}"


# --- shared frames --------------------------------------------------------


def _sets(events: DataFrame, max_size: int, tw: int = TW):
    adjacent = saved(adjacency.within(adjacency.next_events(events), tw), "adjacent")
    comp = saved(components.maximal_subgraphs(events, tw, adjacent), "comp")
    return adjacent, comp, subgraphs.valid_sets(events, adjacent, comp, max_size)


def _ids(df: DataFrame) -> DataFrame:
    return df.select(subgraphs.ids_text().alias("ids"))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = user_item_events(spark, sf_dir)
    sets = motifs.find_sets(events, SPEC)
    return sets, motifs.places_with_counts(events, sets, user_item_types(events), SPEC, 2)


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = user_item_events(spark, sf_dir)
    return motifs.counted_places(events, motifs.find_sets(events, SPEC), user_item_types(events), SPEC, 2)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_item_events(spark, sf_dir)
    return motifs.motif_counts(motifs.find_sets(events, SPEC), user_item_types(events), SPEC)


# --- events and sets ------------------------------------------------------


@query(_with(ADJ, "SELECT a, b, gap FROM adjall"))
def adjacency_pairs(spark, sf_dir):
    return adjacency.next_events(user_item_events(spark, sf_dir))


@query(_with(ADJ, "SELECT b AS a, a AS b, gap FROM adjall"))
def previous_pairs(spark, sf_dir):
    return adjacency.previous_events(user_item_events(spark, sf_dir))


@query(_with(ADJ, "SELECT a, b, gap FROM adjall WHERE gap BETWEEN 0 AND 600"))
def adjacency_gap_window(spark, sf_dir):
    return adjacency.within(adjacency.next_events(user_item_events(spark, sf_dir)), 600)


@query(
    _with(
        ADJ,
        "SELECT node, event_id, row_number() OVER w AS place, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM ne WINDOW w AS (PARTITION BY node ORDER BY event_id)",
    )
)
def node_event_index(spark, sf_dir):
    return adjacency.node_index(user_item_events(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@query(_with(EV, "SELECT event_id FROM ev WHERE t0 BETWEEN (SELECT arg_min(t0, event_id) FROM ev) + 86400 AND (SELECT arg_max(t0, event_id) FROM ev) - 86400"))
def time_window(spark, sf_dir):
    return adjacency.in_window(user_item_events(spark, sf_dir), 86400).select("event_id")


@query(_with(COMP, "SELECT event_id, comp FROM comp"))
def maximal_subgraphs(spark, sf_dir):
    return components.maximal_subgraphs(user_item_events(spark, sf_dir), TW)


@query(_with(COMP, "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM comp GROUP BY comp) GROUP BY size"))
def component_sizes(spark, sf_dir):
    comp = components.maximal_subgraphs(user_item_events(spark, sf_dir), TW)
    return comp.groupBy("comp").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(_with(SETS2, "SELECT DISTINCT ids FROM sets"))
def subgraphs_m2(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    return _ids(subgraphs.connected_sets(events, adjacency.within(adjacency.next_events(events), TW), 2))


@query(_with(SETS3, "SELECT DISTINCT ids FROM sets"))
def subgraphs_m3(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    return _ids(subgraphs.connected_sets(events, saved(adjacency.within(adjacency.next_events(events), TW)), 3))


@query(_with(SETS3 + VALID, "SELECT ids FROM valid"))
def valid_subgraphs(spark, sf_dir):
    return _ids(_sets(user_item_events(spark, sf_dir), 3)[2])


_EDGES = "s1 || '>' || d1 || ':' || c1 || CASE WHEN s2 IS NULL THEN '' ELSE ' ' || s2 || '>' || d2 || ':' || c2 END"


@query(_with(FLAT, f"SELECT {_EDGES} AS edges, cnt FROM loc"))
def location_counts(spark, sf_dir):
    counts = subgraphs.location_counts(_sets(user_item_events(spark, sf_dir), 2)[2])
    one = lambda e: F.concat(e["src"].cast("string"), F.lit(">"), e["dst"].cast("string"), F.lit(":"), e["etype"].cast("string"))
    return counts.select(F.array_join(F.transform("edges", one), " ").alias("edges"), "cnt")


# --- motifs ---------------------------------------------------------------


@query(_with(NAMED, "SELECT typed AS motif, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS n_loc FROM nm WHERE c2 IS NULL OR c1 = c2 GROUP BY typed"))
def motifs_typed(spark, sf_dir):
    return _report(spark, sf_dir).select("motif", "count", "n_loc")


@query(_with(NAMED, "SELECT plain AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm GROUP BY plain"))
def motifs_untyped(spark, sf_dir):
    counts = subgraphs.location_counts(_sets(user_item_events(spark, sf_dir), 2)[2])
    return network.untyped(counts).groupBy("motif").agg(F.sum("cnt").alias("count"))


@query(_with(NAMED, "SELECT CASE plain WHEN '[0,0,0] 0>1:1 2>0:1' THEN '[0,0,0] 0>1:1 1>2:1' ELSE plain END AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm GROUP BY 1"))
def motifs_static(spark, sf_dir):
    counts = subgraphs.location_counts(_sets(user_item_events(spark, sf_dir), 2)[2])
    return network.static_counts(counts)


@query(
    _with(
        SETS2.replace("UNION ALL SELECT a || ',' || b, a, unnest([a, b]) FROM adj)", "WHERE false)")
        + """, mx AS (SELECT comp, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids, count(*) AS n FROM comp GROUP BY comp),
ok AS (SELECT comp FROM (SELECT comp, node, max(place) - min(place) + 1 = count(*) AS ok FROM comp JOIN pl USING (event_id) GROUP BY comp, node) GROUP BY comp HAVING bool_and(ok))""",
        "SELECT ids FROM mx JOIN ok USING (comp)",
    )
)
def maximal_motifs(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    return _ids(subgraphs.maximal_sets(events, components.maximal_subgraphs(events, TW)))


@query(_with(NAMED, "SELECT typed AS motif, CASE WHEN s2 IS NULL THEN 'CR' WHEN i2 = 0 AND j2 = 1 THEN 'CR' WHEN i2 = 0 THEN 'CRR' WHEN j2 = 1 THEN 'CRC' END AS roles FROM nm GROUP BY ALL"))
def node_roles(spark, sf_dir):
    counts = subgraphs.location_counts(_sets(user_item_events(spark, sf_dir), 2)[2])
    keys = network.with_motifs(counts, user_item_types(user_item_events(spark, sf_dir))).select("motif").distinct()
    ntypes, events = parse(F.col("motif"))
    return keys.select("motif", F.array_join(roles(F.size(ntypes), events), "").alias("roles"))


@query(
    _with(
        NAMED,
        """SELECT motif, count FROM (SELECT typed AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm WHERE c2 IS NULL OR c1 = c2 GROUP BY typed)
 WHERE count >= 2 AND motif LIKE '%11%' AND motif NOT LIKE '%10%' AND (motif LIKE '% 0>1:1' OR motif LIKE '%:1 %')""",
    )
)
def motif_filter_policy(spark, sf_dir):
    q = MotifQuery(min_count=2, node_types=[11, 20], node_policy="all", other_nodes=False, event_types=[1], event_policy="one", other_events=False)
    return q.run(_report(spark, sf_dir)).select("motif", "count")


@query(
    _with(
        NAMED,
        "SELECT typed AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm WHERE c1 = c2 AND plain IN ('[0,0,0] 0>1:1 0>2:1', '[0,0,0] 0>1:1 2>1:1') GROUP BY typed",
    )
)
def motif_like(spark, sf_dir):
    q = MotifQuery(like={"motif": ["[0,0,0] 0>1:1 0>2:1"], "digraph": ["[0,0,0] 0>1 2>1"]})
    return q.run(_report(spark, sf_dir)).select("motif", "count")


@query(
    _with(
        NAMED,
        """SELECT grp, motif, count, round(count / sum(count) OVER (PARTITION BY grp), 9) AS rel_count, place FROM
 (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY count DESC, motif) AS place FROM
 (SELECT plain AS grp, typed AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm WHERE c2 IS NULL OR c1 = c2 GROUP BY plain, typed)) """,
    )
)
def motif_group_rank(spark, sf_dir):
    out = MotifQuery(group_by="motif").run(_report(spark, sf_dir))
    return out.select("grp", "motif", "count", F.round("rel_count", 9).alias("rel_count"), F.col("place").cast("long").alias("place"))


@query(
    _with(
        NAMED,
        "SELECT replace(replace(typed, '10', '11'), '[11,20,11]', '[11,20,11]') AS motif, CAST(sum(cnt) AS BIGINT) AS count FROM nm WHERE (c2 IS NULL OR c1 = c2) GROUP BY 1",
    )
)
def motif_remapped(spark, sf_dir):
    return MotifQuery(type_map={10: 11}).filtered(_report(spark, sf_dir)).select("motif", "count")


@query(
    _with(
        NAMED,
        """SELECT DISTINCT plain AS motif, CASE plain WHEN '[0,0] 0>1:1' THEN '1-1-1-1' WHEN '[0,0] 0>1:1 0>1:1' THEN '1-1-2-1'
 WHEN '[0,0,0] 0>1:1 0>2:1' THEN '2-1-1-1' WHEN '[0,0,0] 0>1:1 2>1:1' THEN '2-2-1-1' END AS label FROM nm WHERE c2 IS NULL OR c1 = c2""",
    )
)
def topology_labels(spark, sf_dir):
    return chart_labels(_report(spark, sf_dir))


@query(_with(NAMED, "SELECT DISTINCT typed AS motif, CASE WHEN s2 IS NULL OR j2 < 2 AND i2 < 2 THEN 2 ELSE 3 END AS nof_nodes, CASE WHEN s2 IS NULL THEN 1 ELSE 2 END AS nof_events, CASE WHEN s2 IS NULL OR j2 < 2 AND i2 < 2 THEN 1 ELSE 2 END AS nof_edges FROM nm WHERE c2 IS NULL OR c1 = c2"))
def motif_properties(spark, sf_dir):
    return with_levels(_report(spark, sf_dir)).select("motif", "nof_nodes", "nof_events", "nof_edges")


# --- networks of events and the null model --------------------------------


@query(_with(EV, "SELECT src, dst, count(*) AS w FROM ev GROUP BY src, dst"))
def aggregate_net(spark, sf_dir):
    return network.aggregate_net(user_item_events(spark, sf_dir))


@query(_with(EV, "SELECT src, dst, etype, count(*) AS w FROM ev GROUP BY src, dst, etype"))
def typed_net(spark, sf_dir):
    return network.typed_net(user_item_events(spark, sf_dir))


@query(_with(EV, "SELECT w, count(*) AS n FROM (SELECT count(*) AS w FROM ev GROUP BY src, dst) GROUP BY w"))
def weight_distribution(spark, sf_dir):
    return network.weight_distribution(network.aggregate_net(user_item_events(spark, sf_dir)))


@query(
    _with(
        EV,
        """, d AS (SELECT w, count(*) AS n FROM (SELECT count(*) AS w FROM ev GROUP BY src, dst) GROUP BY w),
k AS (SELECT w, coalesce(sum(n) OVER (ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(n) OVER () AS total FROM d)
SELECT CAST(row_number() OVER (ORDER BY w) - 1 AS INT) AS bin, w AS lo, coalesce(lead(w) OVER (ORDER BY w), w + 1) AS hi FROM k WHERE above >= floor(0.01 * total)""".replace(", d AS", ", d AS", 1),
    )
)
def bin_limits(spark, sf_dir):
    return nullmodel.bin_limits(nullmodel.omit_heaviest(network.aggregate_net(user_item_events(spark, sf_dir)), 0.01))


@query(_with(SPACE, "SELECT plain AS motif, count(*) AS n FROM pn GROUP BY plain"))
def location_space_m2(spark, sf_dir):
    bnet = saved(motifs.binned_edges(user_item_events(spark, sf_dir), None, SPEC), "binned-net")
    rows = network.keyed(network.place_totals(bnet, 2), F.col("events"), 2)
    return rows.groupBy(F.col("ref_key").alias("motif")).agg(F.sum("n").alias("n"))


@query(_with(SPACE, "SELECT replace(regexp_replace(plain, '^\\[[0,]*\\] ', ''), ':1', '') AS pattern, count(*) AS n FROM pn WHERE s2 IS NOT NULL GROUP BY 1"))
def location_totals_m2(spark, sf_dir):
    return network.sequence_totals(network.typed_net(user_item_events(spark, sf_dir)))


@query(_with(SPACE, "SELECT kept AS ref_key, bins, CAST(cnt AS BIGINT) AS value, count(*) AS n FROM pn GROUP BY ALL"))
def null_cells(spark, sf_dir):
    cells = nullmodel.summed_cells(*_counted(spark, sf_dir))
    return cells.withColumn("bins", F.array_join(F.transform("bins", lambda b: b.cast("string")), ","))


@query(_with(SPACE, "SELECT typed AS motif, round(ref_avg, 6) AS ref_avg, round(ref_std, 6) AS ref_std, n_loc_tot, n_loc FROM ex"))
def ref_expectation(spark, sf_dir):
    totals, hits = _counted(spark, sf_dir)
    out = nullmodel.expectation(nullmodel.alike_summed(totals, hits), nullmodel.cell_moments(nullmodel.summed_cells(totals, hits)))
    return out.select("motif", F.round("ref_avg", 6).alias("ref_avg"), F.round("ref_std", 6).alias("ref_std"), "n_loc_tot", "n_loc")


@query(
    _with(
        SPACE + _named("loc", "nm") + ", ct AS (SELECT typed, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS n_loc FROM nm WHERE c2 IS NULL OR c1 = c2 GROUP BY typed)",
        """SELECT typed AS motif, coalesce(count, 0) AS count, round(ref_avg, 6) AS ref_avg, CASE WHEN ref_std > 1e-9 THEN round((coalesce(count, 0) - ref_avg) / ref_std, 4) ELSE 0.0 END AS z_score,
 n_loc_tot, coalesce(ct.n_loc, ex.n_loc) AS n_loc FROM ex FULL JOIN ct USING (typed)""",
    )
)
def motif_report(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    spec = motifs.MotifSpec(tw=TW, max_size=2, references=0)
    out = motifs.find_motifs(events, spec, user_item_types(events))
    z = F.when(F.col("ref_std") > 1e-9, F.round("z_score", 4)).otherwise(0.0)
    return out.select("motif", "count", F.round("ref_avg", 6).alias("ref_avg"), z.alias("z_score"), "n_loc_tot", "n_loc")


_SAMPLED = (
    SPACE
    + """, hist AS (SELECT kept, bins, cnt AS v, count(*) AS n FROM pn GROUP BY ALL),
cum AS (SELECT kept, bins, v, sum(n) OVER (PARTITION BY kept, bins ORDER BY v) / sum(n) OVER (PARTITION BY kept, bins) AS upto FROM hist),
dr AS (SELECT typed, ref, kept, bins, (('0x' || substr(md5('11#' || ref || '#' || replace(s1 || '>' || d1 || '>' || c1 || CASE WHEN s2 IS NULL THEN '' ELSE ' ' || s2 || '>' || d2 || '>' || c2 END, '', '')), 1, 8))::BIGINT) / 4294967296.0 AS u
 FROM pn, (SELECT unnest([1, 2, 3]) AS ref)),
pick AS (SELECT typed, ref, (SELECT coalesce(min(v) FILTER (upto > u), max(v)) FROM cum c WHERE c.kept = dr.kept AND c.bins = dr.bins) AS v FROM dr)"""
)


@query(_with(_SAMPLED, "SELECT typed AS motif, ref, CAST(sum(v) AS BIGINT) AS total, count(*) FILTER (v > 0) AS hit FROM pick GROUP BY typed, ref"))
def sampled_references(spark, sf_dir):
    places = saved(_places(spark, sf_dir)[1], "places")
    return nullmodel.sampled(places, nullmodel.cells(places), 3, 11)


# --- networks -------------------------------------------------------------

UV = EV + ", g AS (SELECT src AS u, dst AS v, CAST(count(*) AS DOUBLE) AS w FROM ev GROUP BY src, dst), bw AS (SELECT u, v, w FROM g UNION ALL SELECT v, u, w FROM g)"
UV2 = UV + ", h AS (SELECT * FROM g), hb AS (SELECT u, v FROM h UNION ALL SELECT v, u FROM h)"
#: Trade between nations: items ordered from one and supplied by the other; ``tr`` is the network thresholded at the mean weight.
TRADE = """tr0 AS (SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, CAST(count(*) AS DOUBLE) AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
tr AS (SELECT * FROM tr0 WHERE w >= (SELECT avg(w) FROM tr0))"""


def _net(spark: SparkSession, sf_dir: str) -> Graph:
    net = network.aggregate_net(user_item_events(spark, sf_dir))
    return Graph.of(net.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("w").cast("double").alias("w")))


def _trade(spark: SparkSession, sf_dir: str, whole: bool = False) -> Graph:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.filter("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v")).agg(F.count("*").cast("double").alias("w"))
    pairs = saved(pairs, "trade")
    if whole:
        return Graph.of(pairs)
    mean = pairs.agg(F.avg("w").alias("m"))
    return Graph.of(pairs.crossJoin(F.broadcast(mean)).filter("w >= m").select("u", "v", "w"))


@query(_with(UV, "SELECT u AS node, count(DISTINCT v) AS degree FROM bw GROUP BY u"))
def degree(spark, sf_dir):
    return graphs.degrees(_net(spark, sf_dir)).select("node", "degree")


@query(_with(UV, "SELECT u AS node, sum(w) AS strength FROM bw GROUP BY u"))
def strength(spark, sf_dir):
    return graphs.strengths(_net(spark, sf_dir))


@query(_with(UV, "SELECT u, v, w FROM g WHERE w > 1"))
def threshold(spark, sf_dir):
    return graphs.threshold(_net(spark, sf_dir), 1, ">").edges


@query(
    _with(
        UV,
        """, n AS (SELECT u AS node, sum(w) AS s, count(*) AS k FROM bw GROUP BY u)
SELECT g.u, g.v, g.w FROM g JOIN n a ON a.node = g.u JOIN n b ON b.node = g.v WHERE pow(1 - w / a.s, a.k - 1) < 0.3 OR pow(1 - w / b.s, b.k - 1) < 0.3""",
    )
)
def local_threshold(spark, sf_dir):
    return graphs.local_threshold(_net(spark, sf_dir), 0.3).edges


@query(_with(UV, "SELECT u, v, w FROM g WHERE u % 3 = 0 AND v % 3 = 0"))
def induced_subnet(spark, sf_dir):
    g = _net(spark, sf_dir)
    return graphs.induced(g, g.nodes.filter("node % 3 = 0")).edges


@query(
    _with(
        UV,
        """, k AS (SELECT u, count(*) AS k FROM g GROUP BY u)
SELECT a.v AS u, b.v AS v, round(sum(1.0 / k), 6) AS w FROM g a JOIN g b ON a.u = b.u AND a.v < b.v JOIN k ON k.u = a.u GROUP BY 1, 2""",
    )
)
def bipartite_projection(spark, sf_dir):
    pairs = network.aggregate_net(user_item_events(spark, sf_dir)).select(F.col("dst").alias("kept"), F.col("src").alias("removed"))
    return graphs.project(pairs).select("u", "v", F.round("w", 6).alias("w"))


@query(
    _with(
        UV2,
        """, nm AS (SELECT u || '~' || v AS e, unnest([u, v]) AS node FROM h), k AS (SELECT node, count(*) AS k FROM nm GROUP BY node)
SELECT a.e, b.e AS f, round(sum(1.0 / (k - 1)), 6) AS w FROM nm a JOIN nm b ON a.node = b.node AND a.e < b.e JOIN k ON k.node = a.node GROUP BY 1, 2""",
    )
)
def line_graph(spark, sf_dir):
    return graphs.line_graph(_net(spark, sf_dir), weighted=True, digits=6)


#: Starts of paths, drawn from all nodes by a seed as the reference's samples are: those that SQL goes along too.
PATH_SAMPLE, PATH_SEED = 12, 0
_STEPS = f""", st AS (SELECT u AS s FROM (SELECT DISTINCT u FROM hb) ORDER BY ('0x' || substr(md5('{PATH_SEED}#' || u), 1, 8))::BIGINT, u LIMIT {PATH_SAMPLE}),
p(s, node, d) AS (SELECT s, s, 0 FROM st UNION SELECT p.s, hb.v, p.d + 1 FROM p JOIN hb ON hb.u = p.node WHERE p.d < 9), q AS (SELECT s AS start, node, min(d) AS dist FROM p GROUP BY s, node HAVING min(d) > 0)"""


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _net(spark, sf_dir)
    g = Graph(saved(g.edges), saved(g.nodes))
    return graphs.path_lengths(g, graphs.sampled_starts(g, PATH_SAMPLE, PATH_SEED))


@query(_with(UV2 + _STEPS, "SELECT start, node, dist FROM q"))
def path_lengths(spark, sf_dir):
    return _lengths(spark, sf_dir)


@query(_with(UV2 + _STEPS, "SELECT round(avg(m), 9) AS mean FROM (SELECT avg(dist) AS m FROM q GROUP BY start)"))
def mean_path(spark, sf_dir):
    return graphs.mean_path_length(_lengths(spark, sf_dir)).select(F.round("mean", 9).alias("mean"))


@query(_with(UV2 + _STEPS, "SELECT dist, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM q GROUP BY dist"))
def path_dist(spark, sf_dir):
    return graphs.path_distribution(_lengths(spark, sf_dir)).select("dist", F.round("share", 9).alias("share"))


@query(
    _with(
        UV2,
        """, s0 AS (SELECT min(u) AS node FROM h), s1 AS (SELECT v AS node FROM hb JOIN s0 ON u = node UNION SELECT node FROM s0),
s2 AS (SELECT v AS node FROM hb JOIN s1 ON u = node UNION SELECT node FROM s1)
SELECT u, v, w FROM h WHERE u IN (SELECT node FROM s2) AND v IN (SELECT node FROM s2)""",
    )
)
def snowball(spark, sf_dir):
    g = _net(spark, sf_dir)
    return graphs.snowball(g, g.edges.agg(F.min("u").alias("node")), 2).edges


@query(
    _with(
        UV + ", ws AS (SELECT DISTINCT w AS t FROM g), q(t, node, c) AS (SELECT t, n, n FROM ws, (SELECT DISTINCT u AS n FROM bw) UNION SELECT q.t, bw.v, q.c FROM q JOIN bw ON bw.u = q.node AND bw.w >= q.t WHERE q.c < bw.v)",
        """, l AS (SELECT t, node, min(c) AS c FROM q GROUP BY t, node), k AS (SELECT t, count(DISTINCT node) - count(DISTINCT c) AS joined, t - lag(t, 1, 0.0) OVER (ORDER BY t) AS step FROM l GROUP BY t)
SELECT sum(joined * step) AS weight, max(joined) AS edges FROM k""",
    )
)
def mst_weight(spark, sf_dir):
    g = _net(spark, sf_dir)
    forest = graphs.spanning_forest(Graph(saved(g.edges), g.nodes), maximum=True)
    return forest.agg(F.sum("w").alias("weight"), F.count("*").alias("edges"))


@query(_with(TRADE, "SELECT a.u AS a, a.v AS b, b.v AS c FROM tr0 a JOIN tr0 b ON a.v = b.u JOIN tr0 c ON c.u = a.u AND c.v = b.v"))
def triangles(spark, sf_dir):
    c = cliques.k_cliques(_trade(spark, sf_dir, whole=True), 3)
    return c.select(F.col("clique")[0].alias("a"), F.col("clique")[1].alias("b"), F.col("clique")[2].alias("c"))


@query(
    _with(
        TRADE,
        """SELECT a.u || ',' || a.v || ',' || b.v AS clique, round(pow(a.w * b.w * c.w, 1 / 3.0), 6) AS intensity, least(a.w, b.w, c.w) AS least
 FROM tr0 a JOIN tr0 b ON a.v = b.u JOIN tr0 c ON c.u = a.u AND c.v = b.v""",
    )
)
def clique_intensity(spark, sf_dir):
    g = _trade(spark, sf_dir, whole=True)
    rows = cliques.intensities(g, cliques.k_cliques(g, 3))
    return rows.select(F.array_join(F.transform("clique", lambda x: x.cast("string")), ",").alias("clique"), F.round("intensity", 6).alias("intensity"), "least")


@query(
    _with(
        TRADE
        + """, tri AS (SELECT a.u AS a, a.v AS b, b.v AS c FROM tr a JOIN tr b ON a.v = b.u JOIN tr c ON c.u = a.u AND c.v = b.v),
inc AS (SELECT a || ',' || b || ',' || c AS t, unnest([a || ',' || b, a || ',' || c, b || ',' || c]) AS e FROM tri),
tt AS (SELECT DISTINCT x.t AS p, y.t AS q FROM inc x JOIN inc y ON x.e = y.e),
z(t, c) AS (SELECT t, t FROM (SELECT DISTINCT t FROM inc) UNION SELECT tt.q, z.c FROM z JOIN tt ON tt.p = z.t WHERE z.c < tt.q),
cc AS (SELECT t, min(c) AS c FROM z GROUP BY t),
mm AS (SELECT DISTINCT c, unnest([a, b, tri.c]) AS node FROM tri JOIN (SELECT t, c AS c FROM cc) k ON k.t = a || ',' || b || ',' || tri.c)""".replace("SELECT DISTINCT c, unnest", "SELECT DISTINCT k.c AS c, unnest"),
        "SELECT size, count(*) AS n FROM (SELECT c, count(DISTINCT node) AS size FROM mm GROUP BY c) GROUP BY size",
    )
)
def kclique_communities(spark, sf_dir):
    return communities.size_distribution(cliques.clique_communities(cliques.k_cliques(_trade(spark, sf_dir), 3)))


_PARTS = UV2 + ", z(node, c) AS (SELECT DISTINCT u, u FROM hb UNION SELECT hb.v, z.c FROM z JOIN hb ON hb.u = z.node WHERE z.c < hb.v), pt AS (SELECT node, min(c) AS c FROM z GROUP BY node), sz AS (SELECT c, count(*) AS size FROM pt GROUP BY c)"


def _partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cliques.component_communities(_net(spark, sf_dir))


@query(_with(_PARTS, "SELECT size, count(*) AS n FROM sz GROUP BY size"))
def community_sizes(spark, sf_dir):
    return communities.size_distribution(_partition(spark, sf_dir))


@query(
    _with(
        _PARTS,
        "SELECT round(coalesce((sum(size * size) - max(size) * max(size)) / nullif(sum(size) - max(size), 0), 0.0), 9) AS susceptibility FROM sz",
    )
)
def susceptibility(spark, sf_dir):
    return communities.susceptibility(_partition(spark, sf_dir)).select(F.round("susceptibility", 9).alias("susceptibility"))


def _modulo(df: DataFrame, m: int) -> DataFrame:
    return df.select("node", (F.col("node") % m).cast("long").alias("comm"))


@query(
    _with(
        UV,
        """, s AS (SELECT u AS node, sum(w) AS s, u % 5 AS c FROM bw GROUP BY u), i AS (SELECT sum(w) AS i FROM g WHERE u % 5 = v % 5),
t AS (SELECT 2 * sum(w) AS w2 FROM g), a AS (SELECT sum(x * x) AS a FROM (SELECT sum(s) AS x FROM s GROUP BY c))
SELECT round(2 * i / w2 - a / w2 / w2, 9) AS modularity FROM i, t, a""",
    )
)
def modularity(spark, sf_dir):
    g = _net(spark, sf_dir)
    return communities.modularity(g, _modulo(g.nodes, 5)).select(F.round("modularity", 9).alias("modularity"))


@query(_with(UV, "SELECT u % 5 AS a, u % 7 AS b, count(*) AS n FROM (SELECT DISTINCT u FROM bw) GROUP BY 1, 2"))
def community_overlap(spark, sf_dir):
    nodes = _net(spark, sf_dir).nodes
    return communities.overlaps(_modulo(nodes, 5), _modulo(nodes, 7))


_MI = UV + """, n AS (SELECT DISTINCT u AS node FROM bw), a AS (SELECT node % 5 AS a, count(*) AS na FROM n GROUP BY 1), b AS (SELECT node % 7 AS b, count(*) AS nb FROM n GROUP BY 1),
ab AS (SELECT node % 5 AS a, node % 7 AS b, count(*) AS nab FROM n GROUP BY 1, 2), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM n),
mi AS (SELECT sum(nab / t * log2(nab * t / na / nb)) AS i FROM ab JOIN a USING (a) JOIN b USING (b), t),
h1 AS (SELECT -sum(na / t * log2(na / t)) AS h1 FROM a, t), h2 AS (SELECT -sum(nb / t * log2(nb / t)) AS h2 FROM b, t)"""


@query(_with(_MI, "SELECT round(i, 9) AS information FROM mi"))
def mutual_information(spark, sf_dir):
    nodes = _net(spark, sf_dir).nodes
    return communities.compared(_modulo(nodes, 5), _modulo(nodes, 7)).select(F.round("information", 9).alias("information"))


@query(_with(_MI, "SELECT round(2 * i / (h1 + h2), 9) AS normalised, round(1 - i / greatest(h1, h2), 9) AS distance FROM mi, h1, h2"))
def nmi(spark, sf_dir):
    nodes = _net(spark, sf_dir).nodes
    return communities.compared(_modulo(nodes, 5), _modulo(nodes, 7)).select(F.round("normalised", 9).alias("normalised"), F.round("distance", 9).alias("distance"))


@query("WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) SELECT round(-sum(p * log2(p)), 9) AS entropy FROM p")
def entropy(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return infotheory.entropy(infotheory.probabilities(events, ["event_type"])).select(F.round("entropy", 9).alias("entropy"))


@query(
    """WITH p AS (SELECT event_type AS x, user_id AS y, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY 1, 2), q AS (SELECT *, sum(p) OVER (PARTITION BY y) AS q FROM p)
SELECT round(-sum(p * log2(p / q)), 9) AS entropy FROM q"""
)
def conditional_entropy(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    dist = infotheory.probabilities(events, ["event_type", "user_id"])
    return infotheory.conditional_entropy(dist, ["user_id"]).select(F.round("entropy", 9).alias("entropy"))


@query("SELECT round(quantile_cont(value, 0.9), 9) AS percentile FROM events")
def percentile(spark, sf_dir):
    return stats.percentile(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 0.9).select(F.round("percentile", 9).alias("percentile"))


@query(
    """SELECT value, round(CASE WHEN lead(value) OVER (ORDER BY value DESC) IS NULL THEN 1 ELSE sum(m) OVER (ORDER BY value DESC) / sum(m) OVER () END, 9) AS share
 FROM (SELECT l_quantity AS value, count(*) AS m FROM lineitem GROUP BY 1)"""
)
def cumulative_dist(spark, sf_dir):
    return stats.cumulative(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity").select("value", F.round("share", 9).alias("share"))


@query(_with(TRADE, "SELECT a % 3 AS a, b % 3 AS b, sum(w) AS w FROM (SELECT least(u % 3, v % 3) AS a, greatest(u % 3, v % 3) AS b, w FROM tr0 WHERE u % 3 <> v % 3) GROUP BY 1, 2"))
def community_network(spark, sf_dir):
    g = _trade(spark, sf_dir, whole=True)
    return communities.community_network(g, _modulo(g.nodes, 3))


# --- without SQL ----------------------------------------------------------


#: Starts of paths over the whole network, drawn from all nodes, as the reference's ``maxSamples``; 0 for all.
PATH_STARTS = 1000


def _whole(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = _net(spark, sf_dir)
    g = Graph(saved(g.edges), saved(g.nodes))
    return g, graphs.sampled_starts(g, PATH_STARTS, PATH_SEED)


@query()
def path_lengths_whole(spark, sf_dir):
    return graphs.path_lengths(*_whole(spark, sf_dir))


@query()
def mean_path_whole(spark, sf_dir):
    return graphs.mean_path_length(graphs.path_counts(*_whole(spark, sf_dir)))


@query()
def path_dist_whole(spark, sf_dir):
    return graphs.path_distribution(graphs.path_counts(*_whole(spark, sf_dir)))


@query()
def betweenness(spark, sf_dir):
    return graphs.betweenness(_trade(spark, sf_dir))


@query()
def shuffled_times(spark, sf_dir):
    return shuffles.shuffle_times(user_item_events(spark, sf_dir), 5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["motifs_typed"](spark, sf_dir)
