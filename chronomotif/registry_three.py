"""Queries of motifs of three events, of what is drawn by cell, and of percolation at every weight, with SQL to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.functions.canonical import canonical, parse
from chronomotif.functions.partial import order_labels
from chronomotif.operators import communities, graphs, network, nullmodel, percolation
from chronomotif.plans import motifs
from chronomotif.plans.query import MotifQuery
from chronomotif.registry import NAMED, NETS, SETS3, TRADE, TW, UV, VALID, _modulo, _net, _report, _trade, _with, query
from chronomotif.sources.events import user_item_events, user_item_types
from chronomotif.storage import saved

SPEC3 = motifs.MotifSpec(tw=TW, max_size=3, references=0)

#: Where valid sets of up to three events are: edges s1 > d1 of type c1, then the others or null.
LOC3 = (
    SETS3
    + VALID
    + """, vs3 AS (SELECT list_sort(list(event_id)) AS l FROM sets JOIN valid USING (ids) GROUP BY ids),
loc3 AS (SELECT x.src AS s1, x.dst AS d1, x.etype AS c1, y.src AS s2, y.dst AS d2, y.etype AS c2, z.src AS s3, z.dst AS d3, z.etype AS c3, count(*) AS cnt
 FROM vs3 JOIN ev x ON x.event_id = l[1] LEFT JOIN ev y ON y.event_id = l[2] LEFT JOIN ev z ON z.event_id = l[3] GROUP BY ALL)"""
)


def _keys(rows: str, out: str, more: str) -> str:
    """SQL that sums ``rows`` (s1 .. c3 and ``more``) by key: ``typed``, ``kept`` (types of nodes forgotten) and ``n``; nodes are named by first appearance."""
    nt = "CASE WHEN x >= 1000000 THEN 20 ELSE 10 + x % 2 END"
    steps = [f"{out}0 AS (SELECT *, [s1, d1] AS m FROM {rows})"]
    for k, c in enumerate(("s2", "d2", "s3", "d3")):
        steps.append(f"{out}{k + 1} AS (SELECT * REPLACE (CASE WHEN {c} IS NULL OR list_contains(m, {c}) THEN m ELSE list_append(m, {c}) END AS m) FROM {out}{k})")
    places = ", ".join(f"list_position(m, {c}) - 1 AS p{c}" for c in ("s2", "d2", "s3", "d3"))
    events = "'] 0>1:' || c1 || " + " || ".join(f"CASE WHEN c{k} IS NULL THEN '' ELSE ' ' || ps{k} || '>' || pd{k} || ':' || c{k} END" for k in (2, 3))
    steps.append(f"{out}5 AS (SELECT [{nt} for x in m] AS nt, {places}, c1, c2, c3, {more}, count(*) AS n FROM {out}4 GROUP BY ALL)")
    steps.append(f"{out} AS (SELECT '[' || array_to_string(nt, ',') || {events} AS typed, '[' || array_to_string([0 for x in nt], ',') || {events} AS kept, {more}, n FROM {out}5)")
    return ", " + ", ".join(steps)


#: All places of up to three edges, made one by one, with their counts.
SPACE3 = (
    LOC3
    + NETS
    + """, ti AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM tb), inc AS (SELECT unnest([src, dst]) AS node, etype, id FROM ti),
q1 AS (SELECT id AS x, NULL::BIGINT AS y, NULL::BIGINT AS z FROM ti),
q2 AS MATERIALIZED (SELECT DISTINCT t.x, inc.id AS y FROM (SELECT id AS x, etype, unnest([src, dst]) AS node FROM ti) t JOIN inc USING (node, etype)),
q3 AS (SELECT DISTINCT t.x, t.y, inc.id AS z FROM (SELECT x, y, a.etype, unnest(list_distinct([a.src, a.dst, b.src, b.dst])) AS node FROM q2 JOIN ti a ON a.id = x JOIN ti b ON b.id = y) t JOIN inc USING (node, etype)),
q AS (SELECT * FROM q1 UNION ALL SELECT x, y, NULL FROM q2 UNION ALL SELECT * FROM q3),
sq3 AS (SELECT a.src AS s1, a.dst AS d1, a.etype AS c1, b.src AS s2, b.dst AS d2, b.etype AS c2, c.src AS s3, c.dst AS d3, c.etype AS c3, concat_ws(',', a.bin, b.bin, c.bin) AS bins
 FROM q JOIN ti a ON a.id = x LEFT JOIN ti b ON b.id = y LEFT JOIN ti c ON c.id = z),
sp3 AS (SELECT sq3.*, coalesce(cnt, 0) AS cnt FROM sq3 LEFT JOIN loc3 ON sq3.s1 = loc3.s1 AND sq3.d1 = loc3.d1 AND sq3.c1 = loc3.c1
 AND sq3.s2 IS NOT DISTINCT FROM loc3.s2 AND sq3.d2 IS NOT DISTINCT FROM loc3.d2 AND sq3.c2 IS NOT DISTINCT FROM loc3.c2
 AND sq3.s3 IS NOT DISTINCT FROM loc3.s3 AND sq3.d3 IS NOT DISTINCT FROM loc3.d3 AND sq3.c3 IS NOT DISTINCT FROM loc3.c3)"""
    + _keys("sp3", "pn", "bins, cnt")
    + """, mom AS (SELECT kept, bins, sum(n) AS total, sum(cnt * n) / sum(n) AS mean, sum(cnt * cnt * n) / sum(n) - (sum(cnt * n) / sum(n)) ** 2 AS var FROM pn GROUP BY kept, bins),
ex AS (SELECT typed, sum(n * mean) AS ref_avg, sqrt(sum(n * greatest(var, 0))) AS ref_std, CAST(sum(n) AS BIGINT) AS n_loc_tot, CAST(coalesce(sum(n) FILTER (cnt > 0), 0) AS BIGINT) AS n_loc
 FROM pn JOIN mom USING (kept, bins) GROUP BY typed)"""
)


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = user_item_events(spark, sf_dir)
    return motifs.counted_places(events, motifs.find_sets(events, SPEC3), user_item_types(events), SPEC3, 3)


@query(_with(SPACE3, "SELECT typed AS motif, bins, CAST(sum(n) AS BIGINT) AS n FROM pn GROUP BY typed, bins"))
def place_totals_m3(spark, sf_dir):
    events = user_item_events(spark, sf_dir)
    bnet = motifs.binned_edges(events, user_item_types(events), SPEC3)
    rows = network.keyed(network.place_totals(bnet, 3), F.col("events"), 0)
    return rows.groupBy("motif", F.array_join(F.transform("bins", lambda b: b.cast("string")), ",").alias("bins")).agg(F.sum("n").alias("n"))


@query(
    _with(
        SPACE3
        + _keys("(SELECT * FROM loc3 WHERE coalesce(c2, c1) = c1 AND coalesce(c3, c1) = c1)", "nm", "cnt")
        + ", ct AS (SELECT typed, CAST(sum(cnt * n) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS n_loc FROM nm GROUP BY typed)",
        """SELECT typed AS motif, coalesce(count, 0) AS count, round(ref_avg, 6) AS ref_avg, CASE WHEN ref_std > 1e-9 THEN round((coalesce(count, 0) - ref_avg) / ref_std, 4) WHEN ref_std IS NULL THEN NULL ELSE 0.0 END AS z_score,
 n_loc_tot, coalesce(ct.n_loc, ex.n_loc) AS n_loc FROM ex FULL JOIN ct USING (typed)""",
    )
)
def motif_report_m3(spark, sf_dir):
    """The reference run: three events, exact expectations."""
    events = user_item_events(spark, sf_dir)
    out = motifs.find_motifs(events, SPEC3, user_item_types(events))
    z = F.when(F.col("ref_std") > 1e-9, F.round("z_score", 4)).when(F.col("ref_std").isNotNull(), F.lit(0.0))
    return out.select("motif", "count", F.round("ref_avg", 6).alias("ref_avg"), z.alias("z_score"), "n_loc_tot", "n_loc")


REFERENCES = 1000


@query(_with(SPACE3, f"SELECT typed AS motif, round(ref_avg, 6) AS ref_avg, {REFERENCES} AS n_ref, TRUE AS mean_held, TRUE AS spread_held FROM ex"))
def drawn_references_m3(spark, sf_dir):
    """A thousand references of three events, drawn by cell: whether their mean and variance lie within six of their errors of the exact ones."""
    totals, hits = _counted(spark, sf_dir)
    cells, alike = saved(nullmodel.summed_cells(totals, hits), "cells"), saved(nullmodel.alike_summed(totals, hits), "alike")
    exact = nullmodel.expectation(alike, nullmodel.cell_moments(cells))
    largest = cells.agg(F.max("value")).first()[0] or 0
    drawn = nullmodel.drawn_by_cell(alike, cells, REFERENCES, 11).groupBy("motif").agg(F.count("*").cast("int").alias("n_ref"), F.avg("total").alias("mean"), F.var_pop("total").alias("spread"))
    var = F.col("ref_std") * F.col("ref_std")
    held = F.abs(F.col("mean") - F.col("ref_avg")) <= 6 * F.col("ref_std") / REFERENCES**0.5 + 1e-6
    # The fourth cumulant of a sum of bounded counts is at most the largest one's square times the second moments.
    error = F.sqrt((2 * var * var + largest**2 * (var + F.col("ref_avg"))) / REFERENCES)
    spread = F.abs(F.col("spread") - var) <= 6 * error + var / REFERENCES + 1e-6
    return exact.join(drawn, "motif").select("motif", F.round("ref_avg", 6).alias("ref_avg"), "n_ref", held.alias("mean_held"), spread.alias("spread_held"))


# --- motifs whose events share an order only where they share nodes -------------

#: Sets found, each as it is (``sw`` 0) and with the two events swapped that no order binds (``sw`` 1), keyed.
BOTH3 = (
    LOC3
    + """, one AS (SELECT *, row_number() OVER () AS rid FROM loc3 WHERE coalesce(c2, c1) = c1 AND coalesce(c3, c1) = c1),
ways AS (SELECT *, 0 AS sw, 't' AS kind FROM one WHERE c3 IS NULL OR (len(list_intersect([s1, d1], [s2, d2])) > 0 AND len(list_intersect([s2, d2], [s3, d3])) > 0)
 UNION ALL SELECT *, 0, 'l' FROM one WHERE c3 IS NOT NULL AND len(list_intersect([s1, d1], [s2, d2])) = 0
 UNION ALL SELECT s2, d2, c2, s1, d1, c1, s3, d3, c3, cnt, rid, 1, 'l' FROM one WHERE c3 IS NOT NULL AND len(list_intersect([s1, d1], [s2, d2])) = 0
 UNION ALL SELECT *, 0, 'f' FROM one WHERE c3 IS NOT NULL AND len(list_intersect([s2, d2], [s3, d3])) = 0
 UNION ALL SELECT s1, d1, c1, s3, d3, c3, s2, d2, c2, cnt, rid, 1, 'f' FROM one WHERE c3 IS NOT NULL AND len(list_intersect([s2, d2], [s3, d3])) = 0)"""
    + _keys("ways", "wk", "rid, sw, kind, cnt")
    + ", cls AS (SELECT rid, min(typed) AS least, max(typed) FILTER (sw = 0) AS own, any_value(cnt) AS cnt, any_value(kind) AS kind FROM wk GROUP BY rid)"
)


def _found3(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_item_events(spark, sf_dir)
    return motifs.motif_counts(motifs.find_sets(events, SPEC3), user_item_types(events), SPEC3)


@query(_with(BOTH3, "SELECT min(own) AS motif, count(DISTINCT own) AS orders, CAST(sum(cnt) AS BIGINT) AS count, count(*) AS n_loc FROM cls GROUP BY least"))
def motifs_partial_order(spark, sf_dir):
    """Motifs of up to three events whose order is only what shared nodes give, under the least of the totally ordered ones each stands for."""
    ntypes, events = parse(F.col("motif"))
    keyed = _found3(spark, sf_dir).withColumn("part", canonical(ntypes, events, "order"))
    return keyed.groupBy("part").agg(F.min("motif").alias("motif"), F.count("*").alias("orders"), F.sum("count").alias("count"), F.sum("n_loc").alias("n_loc")).drop("part")


@query(
    _with(
        BOTH3,
        "SELECT DISTINCT own AS motif, CASE WHEN kind = 'l' THEN '1a 1b 2ab' WHEN kind = 'f' THEN '1 2a 2b' WHEN own LIKE '% % % %' THEN '1 2 3' WHEN own LIKE '% % %' THEN '1 2' ELSE '' END AS labels FROM cls",
    )
)
def partial_order_labels(spark, sf_dir):
    """Ranks and sets of the events of each motif, in the partial order of shared nodes."""
    found = _found3(spark, sf_dir)
    return found.select("motif", order_labels(parse(F.col("motif"))[1]).alias("labels")).select("motif", F.array_join(F.array_sort("labels"), " ").alias("labels"))


#: Motifs of up to two events and their key in each of ten forms: the least over all orders of their nodes.
FORMS = (
    NAMED
    + """, rp AS (SELECT typed AS motif, CAST(sum(cnt) AS BIGINT) AS count, string_split(regexp_extract(typed, '\\[(.*)\\]', 1), ',') AS ts,
 regexp_extract_all(typed, '(\\d+)>', 1) AS i, regexp_extract_all(typed, '>(\\d+)', 1) AS j, regexp_extract_all(typed, ':(\\d+)', 1) AS c FROM nm WHERE c2 IS NULL OR c1 = c2 GROUP BY typed),
ord AS (SELECT unnest([[0, 1], [1, 0], [0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0]]) AS p),
ty AS (SELECT unnest([TRUE, FALSE]) AS by_type),
mv AS (SELECT motif, count, by_type, c, ts, i, j, [CASE WHEN by_type THEN ts[list_position(p, k)] ELSE '0' END for k in range(len(p))] AS nt, [p[CAST(x AS INT) + 1] for x in i] AS a, [p[CAST(x AS INT) + 1] for x in j] AS b
 FROM rp JOIN ord ON len(p) = len(ts) CROSS JOIN ty),
kinds AS (SELECT motif, count, by_type, min(nt || [a[k] || '>' || b[k] || CASE WHEN by_type THEN c[k] ELSE '1' END for k in range(1, len(a) + 1)].list_sort()) AS multigraph,
 min(nt || [a[k] || '>' || b[k] for k in range(1, len(a) + 1)].list_distinct().list_sort()) AS digraph,
 min(nt || [least(a[k], b[k]) || '-' || greatest(a[k], b[k]) for k in range(1, len(a) + 1)].list_distinct().list_sort()) AS graph,
 any_value(list_sort(ts)) AS nodes, any_value(CASE WHEN by_type THEN [motif] ELSE [regexp_replace(regexp_extract(motif, '\\] (.*)', 1), ':\\d+', '', 'g'), CAST(len(ts) AS VARCHAR)] END) AS motif_form
 FROM mv GROUP BY motif, count, by_type),
forms AS (SELECT motif, count, by_type, unnest(['motif', 'multigraph', 'digraph', 'graph', 'nodes']) AS level, unnest([motif_form, multigraph, digraph, graph, nodes]) AS grp FROM kinds)"""
)


@query(_with(FORMS, "SELECT by_type, level, min(motif) AS motif, count(*) AS members, CAST(sum(count) AS BIGINT) AS count FROM forms GROUP BY by_type, level, grp"))
def motif_groups(spark, sf_dir):
    """Groups of the report in all ten forms: with types and without, at five levels; a group goes by its least motif."""
    report = saved(_report(spark, sf_dir).select("motif", "count"), "report")
    out = None
    for by_type in (True, False):
        for level in ("motif", "multigraph", "digraph", "graph", "nodes"):
            rows = MotifQuery(group_by=level, group_typed=by_type).run(report).groupBy("grp").agg(F.min("motif").alias("motif"), F.count("*").alias("members"), F.sum("count").alias("count"))
            rows = rows.select(F.lit(by_type).alias("by_type"), F.lit(level).alias("level"), "motif", "members", "count")
            out = rows if out is None else out.unionByName(rows)
    return out


# --- percolation at every weight ------------------------------------------

_SPREAD = """ count(*) AS components, CAST(max(n) AS BIGINT) AS giant, CAST(sum(n * n) AS BIGINT) AS squares,
 round(CASE WHEN sum(n) > max(n) THEN (sum(n * n) - max(n) * max(n)) / CAST(sum(n) - max(n) AS DOUBLE) ELSE 0.0 END, 6) AS susceptibility"""


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("w", "bound").withColumn("susceptibility", F.round("susceptibility", 6))


@query(
    _with(
        UV
        + """, bd AS (SELECT DISTINCT w AS bound FROM g), p(bound, node, c) AS (SELECT bound, u, u FROM bd, (SELECT DISTINCT u FROM bw) UNION SELECT p.bound, bw.v, p.c FROM p JOIN bw ON bw.u = p.node AND bw.w >= p.bound WHERE p.c < bw.v),
l AS (SELECT bound, node, min(c) AS c FROM p GROUP BY bound, node), s AS (SELECT bound, c, count(*) AS n FROM l GROUP BY bound, c)""",
        f"SELECT bound, CAST(sum(n) AS BIGINT) AS nodes, {_SPREAD} FROM s GROUP BY bound",
    )
)
def edge_percolation_profile(spark, sf_dir):
    return _rounded(percolation.edge_profile(_net(spark, sf_dir), reverse=True))


@query(
    _with(
        TRADE
        + """, tri AS (SELECT a.u || '-' || a.v AS x, b.u || '-' || b.v AS y, c.u || '-' || c.v AS z, least(a.w, b.w, c.w) AS w FROM tr0 a JOIN tr0 b ON a.v = b.u JOIN tr0 c ON c.u = a.u AND c.v = b.v),
bd AS (SELECT DISTINCT w AS bound FROM tri), on_ AS (SELECT bound, x, y, z FROM tri JOIN bd ON w >= bound),
lk AS (SELECT bound, x AS a, y AS b FROM on_ UNION SELECT bound, y, x FROM on_ UNION SELECT bound, y, z FROM on_ UNION SELECT bound, z, y FROM on_),
p(bound, node, c) AS (SELECT DISTINCT bound, a, a FROM lk UNION SELECT p.bound, lk.b, p.c FROM p JOIN lk ON lk.bound = p.bound AND lk.a = p.node WHERE p.c < lk.b),
l AS (SELECT bound, node, min(c) AS c FROM p GROUP BY bound, node), s AS (SELECT o.bound, c, count(*) AS n FROM on_ o JOIN l ON l.bound = o.bound AND l.node = o.x GROUP BY o.bound, c)""",
        f"SELECT bound, CAST(sum(n) AS BIGINT) AS nodes, {_SPREAD} FROM s GROUP BY bound",
    )
)
def clique_percolation_profile(spark, sf_dir):
    return _rounded(percolation.clique_profile(_trade(spark, sf_dir, whole=True), 3, "least"))


# --- distances from all nodes, trees of communities -----------------------

#: Distances of all pairs that reach each other; the network of users and items has none of ten steps.
_ALL = UV + """, q(start, node, dist) AS (SELECT DISTINCT u, u, 0 FROM bw UNION SELECT q.start, bw.v, q.dist + 1 FROM q JOIN bw ON bw.u = q.node WHERE q.dist < 10),
f AS (SELECT start, node, min(dist) AS dist FROM q GROUP BY start, node), n AS (SELECT dist, count(*) AS pairs FROM f WHERE dist > 0 GROUP BY dist)"""


@query(_with(_ALL, "SELECT dist, pairs FROM n"))
def distances_of_all_pairs(spark, sf_dir):
    """By sketches; the SQL's whole numbers are met as long as no node reaches more than some hundred others."""
    return graphs.neighbourhood_sizes(_net(spark, sf_dir))


@query(_with(_ALL, "SELECT round(sum(dist * pairs) / sum(pairs), 9) AS mean FROM n"))
def mean_distance_of_all_pairs(spark, sf_dir):
    return graphs.mean_distance_of(graphs.neighbourhood_sizes(_net(spark, sf_dir))).select(F.round("mean", 9).alias("mean"))


def _tree(spark: SparkSession, sf_dir: str, *moduli: int) -> DataFrame:
    g = _net(spark, sf_dir)
    return communities.hierarchy([_modulo(g.nodes, m) for m in moduli])


_MODULI = UV + """, nd AS (SELECT DISTINCT u AS node FROM bw), lf AS (SELECT DISTINCT node % 70 AS d, node % 35 AS c, node % 5 AS b FROM nd),
o AS (SELECT *, row_number() OVER (ORDER BY b, c, d) - 1 AS place FROM lf)"""


@query(
    _with(
        _MODULI,
        """SELECT 0 AS level, 0::BIGINT AS comm, NULL::BIGINT AS parent, 0::BIGINT AS first, count(*) AS leaves FROM o UNION ALL SELECT 1, b, 0, min(place), count(*) FROM o GROUP BY b
 UNION ALL SELECT 2, c, c % 5, min(place), count(*) FROM o GROUP BY c UNION ALL SELECT 3, d, d % 35, place, 1 FROM o""",
    )
)
def community_tree_order(spark, sf_dir):
    return communities.tree_order(_tree(spark, sf_dir, 1, 5, 35, 70), 4)


@query(
    _with(
        _MODULI,
        """, t AS (SELECT 5 AS level, d AS comm, 4 AS pl, d % 35 AS parent, 0 AS kids FROM o UNION ALL SELECT 4, c, 3, c % 5, count(*) FROM o GROUP BY c
 UNION ALL SELECT 3, b, 2, b, count(DISTINCT c) FROM o GROUP BY b UNION ALL SELECT DISTINCT 2, b, 1, b, 1 FROM o UNION ALL SELECT DISTINCT 1, b, 0, 0, 1 FROM o UNION ALL SELECT 0, 0, NULL, NULL, count(DISTINCT b) FROM o),
dg AS (SELECT *, kids + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS deg FROM t),
x AS (SELECT a.*, a.deg = 2 AND a.parent IS NOT NULL AND coalesce(p.deg = 2, FALSE) AS gone FROM dg a LEFT JOIN dg p ON p.level = a.pl AND p.comm = a.parent),
r(level, comm, pl, parent) AS (SELECT level, comm, pl, parent FROM x WHERE NOT gone UNION ALL SELECT r.level, r.comm, x.pl, x.parent FROM r JOIN x ON x.level = r.pl AND x.comm = r.parent WHERE x.gone)
SELECT r.level, r.comm, r.pl AS parent_level, r.parent FROM r LEFT JOIN x ON x.level = r.pl AND x.comm = r.parent WHERE NOT coalesce(x.gone, FALSE)""",
    )
)
def community_tree_thinned(spark, sf_dir):
    return communities.thinned(_tree(spark, sf_dir, 1, 5, 5, 5, 35, 70), 6)


@query()
def betweenness_drawn(spark, sf_dir):
    """The whole network of users and items, from drawn paths; tested against all paths, and the error with it."""
    return graphs.drawn_betweenness(_net(spark, sf_dir), seed=11)
