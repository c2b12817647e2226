"""Jobs that must do with bounded rows: what the larger tables showed."""

import numpy as np
from pyspark.sql import functions as F

from chronomotif.operators import adjacency, components, subgraphs


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _events(spark, n, nodes, seed, step=40):
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, n * step, n))
    rows = [(k, int(start[k]), int(start[k]) + 5, int(a), int(100 + b), int(c)) for k, (a, b, c) in enumerate(zip(rng.integers(0, nodes, n), rng.integers(0, nodes, n), rng.integers(0, 2, n), strict=True))]
    return spark.createDataFrame(rows, "event_id long, start long, end long, src long, dst long, etype int")


def test_events_of_a_maximal_subgraph_never_carry_it(spark, monkeypatch):
    """Sets are gathered by stretches of ids, and equal what describing each set as a whole gives."""
    monkeypatch.setattr(subgraphs, "CHUNK", 4)
    events = _events(spark, 60, 5, 3)
    comp = components.maximal_subgraphs(events, 60)
    for gap in (0, 700):
        sets = adjacency.in_window(events, gap).join(comp, "event_id").groupBy("comp").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
        sets = sets.select(F.col("comp").alias("root"), "ids", F.lit(None).cast("long").alias("gap"))
        for most in (None, 6):
            whole = subgraphs.described(sets, events, subgraphs.ranked_nodes(events, comp)).filter("valid").drop("valid")
            out = subgraphs.maximal_sets(events, comp, most, gap)
            assert "explode(ids" not in _plan(out)
            want = {(r["root"], tuple(r["ids"]), tuple(r["edges"])) for r in whole.collect() if not most or len(r["ids"]) <= most}
            assert want and {(r["root"], tuple(r["ids"]), tuple(r["edges"])) for r in out.collect()} == want
            assert sorted(r["t"] for r in out.select(subgraphs.ids_text().alias("t")).collect()) == sorted(",".join(map(str, ids)) for _, ids, _ in want)


def test_space_of_places_is_counted_within_the_bins(spark, tmp_path):
    """An edge type's weight below the lightest edge's is outside all bins, as in the SQL."""
    import datetime

    from chronomotif.registry import location_space_m2

    at = datetime.datetime(2024, 1, 1)
    rows = [(0, at, 1, "a", '{"k": 5}'), (1, at, 1, "b", '{"k": 5}'), (2, at, 2, "a", '{"k": 5}'), (3, at, 2, "a", '{"k": 5}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert {r["motif"]: r["n"] for r in location_space_m2(spark, str(tmp_path)).collect()} == {"[0,0] 0>1:1": 1, "[0,0] 0>1:1 0>1:1": 1}


def test_static_keys_are_searched_once_for_an_ordered_one(spark):
    from chronomotif.operators import network

    events = _events(spark, 60, 4, 5)
    adjacent = adjacency.within(adjacency.next_events(events), 60)
    comp = components.maximal_subgraphs(events, 60, adjacent)
    places = subgraphs.location_counts(subgraphs.valid_sets(events, adjacent, comp, 3))
    out = network.static_counts(places)
    plan = _plan(out)
    assert "sum(cnt" in plan[plan.index("EvalPython") :]
    want = network.untyped(places).groupBy(F.col("static").alias("motif")).agg(F.sum("cnt").alias("count"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_weights_of_a_line_graph_are_rounded_before_edges_meet(spark):
    from chronomotif.operators import graphs
    from chronomotif.sources.nets import Graph

    edges = spark.createDataFrame([(0, k, 1.0) for k in range(1, 9)] + [(1, 2, 1.0), (3, 1, 1.0)], "u long, v long, w double")
    for directed in (False, True):
        g = Graph.of(edges, directed)
        out = graphs.line_graph(g, True, digits=3)
        if not directed:
            assert "round" not in _plan(out)
        want = graphs.line_graph(g, True).select("e", "f", F.round("w", 3).alias("w"))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def _steps(edges, starts, directed):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        if not directed:
            near.setdefault(v, set()).add(u)
    for s in starts:
        at, dist = {s: 0}, 0
        front = {s}
        while front:
            dist += 1
            front = {v for u in front for v in near.get(u, ())} - at.keys()
            at |= dict.fromkeys(front, dist)
        yield from ((s, node, d) for node, d in at.items() if d)


def test_many_starts_go_along_as_bits(spark, monkeypatch):
    """Words of 64 starts, turns of starts, loose ends, both directions, and starts that go nowhere."""
    from chronomotif.operators import graphs
    from chronomotif.sources.nets import Graph

    rng = np.random.default_rng(8)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 70, (170, 2)) if a != b} | {(500, 501), (501, 502)})
    frame = spark.createDataFrame([(u, v, 1.0) for u, v in edges], "u long, v long, w double")
    for directed, together in ((False, 1024), (True, 64)):
        monkeypatch.setattr(graphs, "TOGETHER", together)
        g = Graph.of(frame, directed, spark.createDataFrame([(900,)], "node long"))
        nodes = [r["node"] for r in g.nodes.collect()]
        want = sorted(_steps(edges, nodes, directed))
        assert sorted(map(tuple, graphs.path_lengths(g, g.nodes, not directed).collect())) == want
        counts = graphs.path_counts(g, g.nodes, not directed)
        assert sum(r["n"] for r in counts.collect()) == len(want)
        share = {d: sum(x[2] == d for x in want) / len(want) for d in {x[2] for x in want}}
        assert {r["dist"]: r["share"] for r in graphs.path_distribution(counts).collect()} == share
        each = [np.mean([x[2] for x in want if x[0] == s]) for s in {x[0] for x in want}]
        assert abs(graphs.mean_path_length(counts).first()["mean"] - np.mean(each)) < 1e-9


def test_drawn_paths_meet_before_a_hub_is_opened(spark, monkeypatch):
    """Two leaves meet at their hub: no row for each of its other leaves."""
    from chronomotif.operators import graphs
    from chronomotif.sources.nets import Graph

    frame = spark.createDataFrame([(0, k, 1.0) for k in range(1, 301)] + [(1, 301, 1.0), (301, 302, 1.0)], "u long, v long, w double")
    made, keep = [], graphs.saved
    monkeypatch.setattr(graphs, "saved", lambda df, name="step": made.append((name, keep(df, name))) or made[-1][1])
    drawn = graphs.drawn_betweenness(Graph.of(frame), 2, error=0.2)
    share = {r["node"]: r["share"] for r in drawn.collect()}
    pairs = sum(df.count() for name, df in made if name == "drawn-pairs")
    assert sum(df.count() for name, df in made if name == "drawn-steps") < 12 * pairs
    assert abs(share[0] - 1 + 2 / 303) < 0.2 and share[5] == 0 and share[302] == 0


def test_rewiring_goes_by_blocks(spark, monkeypatch):
    """Degrees, simple edges and weights stay where edges are many blocks; edges that no block had alone come about."""
    from chronomotif.operators import graphs, shuffles
    from chronomotif.sources.nets import Graph

    monkeypatch.setattr(shuffles, "BLOCK_EDGES", 60)
    rng = np.random.default_rng(2)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (300, 2)) if a != b} | {(0, k) for k in range(1, 50)})
    frame = spark.createDataFrame([(u, v, float(k)) for k, (u, v) in enumerate(edges)], "u long, v long, w double")
    plans, keep = [], shuffles.saved
    monkeypatch.setattr(shuffles, "saved", lambda df, name="step": plans.append(df.groupBy("u").count()) or keep(df, name))
    out = shuffles.configuration_model(frame, 4, rounds=6)
    assert len(plans) == 7  # the edges, and a table for each round
    rows = out.collect()
    assert rows == shuffles.configuration_model(frame, 4, rounds=6).collect() or sorted(rows) == sorted(shuffles.configuration_model(frame, 4, rounds=6).collect())
    pairs = {(r["u"], r["v"]) for r in rows}
    assert len(pairs) == len(edges) and all(u < v for u, v in pairs) and sorted(r["w"] for r in rows) == [float(k) for k in range(len(edges))]
    degree = lambda f: {r["node"]: r["degree"] for r in graphs.degrees(Graph.of(f)).collect()}
    assert degree(out) == degree(frame)
    assert len(pairs - set(edges)) > len(edges) / 3


def test_times_are_shuffled_in_groups(spark, monkeypatch):
    """Several groups and rounds: times and edges of a type stay, no overlaps come about, and most times are elsewhere."""
    from collections import Counter

    from chronomotif.operators import shuffles

    monkeypatch.setattr(shuffles, "GROUP_EVENTS", 60)
    rng = np.random.default_rng(6)
    rows = [(k, 40 * k, 40 * k + int(rng.integers(0, 12)), int(rng.integers(0, 9)), int(100 + rng.integers(0, 9)), int(k % 2)) for k in range(240)]
    events = spark.createDataFrame(rows, "event_id long, start long, end long, src long, dst long, etype int")
    groups, keep = [], shuffles._chained
    monkeypatch.setattr(shuffles, "_chained", lambda *a: groups.append(a) or keep(*a))
    for out in (shuffles.constrained_time_shuffle(events, 1), shuffles.biased_time_shuffle(events, 3, 1)):
        got = out.collect()
        assert Counter((r["start"], r["end"], r["etype"]) for r in got) == Counter((s, e, t) for _, s, e, _, _, t in rows)
        assert Counter((r["src"], r["dst"], r["etype"]) for r in got) == Counter((a, b, t) for _, _, _, a, b, t in rows)
        assert sum((r["start"], r["src"], r["dst"]) in {(s, a, b) for _, s, _, a, b, _ in rows} for r in got) < 80
        assert shuffles.overlapping(out).count() == 0
    assert len(groups) == 2 * shuffles.ROUNDS


def test_sketches_are_never_broadcast(spark, monkeypatch):
    from chronomotif.operators import graphs
    from chronomotif.sources.nets import Graph

    plans, keep = [], graphs.saved
    monkeypatch.setattr(graphs, "saved", lambda df, name="step": plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    frame = spark.createDataFrame([(0, k, 1.0) for k in range(1, 6)], "u long, v long, w double")
    assert {r["dist"]: r["pairs"] for r in graphs.neighbourhood_sizes(Graph.of(frame)).collect()} == {1: 10, 2: 20}
    told = [plan for name, plan in plans if name == "reach" and "Join" in plan]
    assert told and not any("Broadcast" in plan for plan in told)
