"""The engine against the known values of a small event list and against brute force on random ones."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronomotif.operators import adjacency, components, network, nullmodel, shuffles, subgraphs
from chronomotif.plans import motifs
from chronomotif.plans.query import MotifQuery, with_levels
from chronomotif.schema import EVENTS, NODE_TYPES

CLUSTERS = ["10 12 32", "10 32 12", "32 10 12", "32 12 10", "12 32 10", "12 10 32", "01 02 13 14"]
TYPES = [(0, 42), (1, 42), (2, 66), (3, 66), (4, 66)]


def fixture_rows():
    rows = []
    for k, c in enumerate(CLUSTERS):
        for j, e in enumerate(c.split()):
            t = 115 + 100 * k + 3 * j
            rows.append((len(rows), t, t, int(e[0]), int(e[1]), 1))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(fixture_rows(), EVENTS)


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame(TYPES, NODE_TYPES)


def test_structure(events):
    adj = adjacency.within(adjacency.next_events(events), 10)
    assert adj.count() == 15
    comp = components.maximal_subgraphs(events, 10)
    sizes = sorted(tuple(r) for r in comp.groupBy("comp").count().collect())
    assert sizes == [(0, 3), (3, 3), (6, 3), (9, 3), (12, 3), (15, 3), (18, 4)]
    sets = subgraphs.valid_sets(events, adj, comp, 3)
    assert {r[0]: r[1] for r in sets.groupBy(F.size("ids")).count().collect()} == {1: 22, 2: 15, 3: 8}
    assert subgraphs.location_counts(sets).count() == 22
    net = {(r["src"], r["dst"]): r["w"] for r in network.aggregate_net(events).collect()}
    assert net == {(1, 0): 6, (1, 2): 6, (3, 2): 6, (0, 1): 1, (0, 2): 1, (1, 3): 1, (1, 4): 1}
    tnet = network.typed_net(events)
    assert network.edge_sequences(tnet, 2).count() == 46
    assert network.edge_sequences(tnet, 3).count() == 299
    assert network.sequence_totals(tnet).agg(F.sum("n")).first()[0] == 46 - 7


GOLDEN = {
    "[42,66] 0>1:1": (9, 9.0, 0.0, 4, 4),
    "[42,42] 0>1:1": (7, 7.0, 0.0, 2, 2),
    "[66,66] 0>1:1": (6, 6.0, 0.0, 1, 1),
    "[42,42,66] 0>1:1 0>2:1": (4, 3.5, 0.5, 4, 2),
    "[42,66,42] 0>1:1 0>2:1": (3, 3.5, 0.5, 4, 1),
    "[42,66,66] 0>1:1 2>1:1": (3, 3.0, 0.0, 2, 1),
    "[66,66,42] 0>1:1 2>1:1": (3, 3.0, 0.0, 2, 1),
    "[42,42,66] 0>1:1 1>2:1": (1, 1.0, 0.707107, 4, 1),
    "[42,66,66] 0>1:1 0>2:1": (1, 1.0, 0.707107, 6, 1),
}


def test_null_model(events, types):
    spec = motifs.MotifSpec(tw=10, max_size=2, references=0)
    rows = {r["motif"]: r for r in motifs.find_motifs(events, spec, types).collect()}
    assert len(rows) == 17
    for key, (count, mean, sd, tot, loc) in GOLDEN.items():
        r = rows[key]
        assert (r["count"], r["n_loc_tot"], r["n_loc"]) == (count, tot, loc)
        assert r["ref_avg"] == pytest.approx(mean) and r["ref_std"] == pytest.approx(sd, abs=1e-5)
    assert sum(r["count"] for r in rows.values()) == 37
    assert sum(r["ref_avg"] for r in rows.values()) == pytest.approx(37)


def test_seeded_references(events, types):
    spec = motifs.MotifSpec(tw=10, max_size=2, references=40, seed=3)
    rows = {r["motif"]: r for r in motifs.find_motifs(events, spec, types).collect()}
    for key, (count, mean, sd, *_) in GOLDEN.items():
        assert rows[key]["n_ref"] == 40 and abs(rows[key]["ref_avg"] - mean) <= 5 * sd / 40**0.5 + 1e-9


def test_three_events(events, types):
    rows = {r["motif"]: r["count"] for r in motifs.find_motifs(events, motifs.MotifSpec(tw=10, max_size=3), types).collect()}
    assert len(rows) == 17
    assert rows["[42,42,66,66] 0>1:1 2>3:1 0>3:1"] == 1 and rows["[66,66,42,42] 0>1:1 2>3:1 2>1:1"] == 1
    assert Counter(rows.values()) == Counter([9, 7, 6, 4, 3, 3, 3] + [1] * 10)


def brute_sets(rows, tw, m):
    """Valid connected sets, straight from the definitions."""
    at = {}
    for e in rows:
        for node in (e[3], e[4]):
            at.setdefault(node, []).append(e)
    adj = {}
    for a in rows:
        after = {n: next((x for x in at[n] if x[0] > a[0]), None) for n in (a[3], a[4])}
        x, y = after[a[3]], after[a[4]]
        nxt = []
        if x and y and x[0] == y[0]:
            nxt = [x]
        else:
            nxt = [z for z in (x, y) if z and {z[3], z[4]} != {a[3], a[4]}]
        for b in nxt:
            if 0 <= b[1] - a[2] <= tw:
                adj.setdefault(a[0], set()).add(b[0])
                adj.setdefault(b[0], set()).add(a[0])
    comp = {}
    for e in rows:
        if e[0] not in comp:
            todo = [e[0]]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = e[0]
                    todo += adj.get(x, ())
    found = set()
    for k in range(1, m + 1):
        for ids in combinations([e[0] for e in rows], k):
            s, seen = set(ids), {ids[0]}
            while True:
                more = {b for a in seen for b in adj.get(a, ()) if b in s} - seen
                if not more:
                    break
                seen |= more
            if seen != s:
                continue
            ok = True
            for node, es in at.items():
                line = [x[0] for x in es if comp[x[0]] == comp[ids[0]]]
                places = [line.index(i) for i in ids if i in line]
                ok &= not places or max(places) - min(places) + 1 == len(places)
            if ok:
                found.add(ids)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_sets_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, t = [], 0
    for k in range(14):
        t += rnd.choice([0, 1, 1, 2, 5])
        a, b = rnd.sample(range(5), 2)
        rows.append((k, t, t + rnd.choice([0, 0, 1, 2]), a, b, rnd.choice([1, 2])))
    df = spark.createDataFrame(rows, EVENTS)
    adj = adjacency.within(adjacency.next_events(df), 4)
    comp = components.maximal_subgraphs(df, 4, adj)
    got = {tuple(r["ids"]) for r in subgraphs.valid_sets(df, adj, comp, 3).collect()}
    assert got == brute_sets(rows, 4, 3)


def test_edge_cases(spark, types):
    none = spark.createDataFrame([], EVENTS)
    assert motifs.find_motifs(none, motifs.MotifSpec(tw=5, max_size=2)).count() == 0
    one = spark.createDataFrame([(0, 1, 1, 7, 8, 1)], EVENTS)
    assert [tuple(r) for r in motifs.find_motifs(one, motifs.MotifSpec(tw=5, max_size=2)).select("motif", "count").collect()] == [("[0,0] 0>1:1", 1)]
    twice = spark.createDataFrame([(0, 1, 1, 7, 8, 1), (1, 6, 6, 7, 8, 1), (2, 12, 12, 7, 8, 1)], EVENTS)
    assert [tuple(r) for r in adjacency.within(adjacency.next_events(twice), 5).collect()] == [(0, 1, 5)]
    with pytest.raises(ValueError):
        motifs.find_motifs(spark.createDataFrame([(0, 1, 1, 7, 7, 1)], EVENTS), motifs.MotifSpec(tw=5, max_size=2))
    with pytest.raises(ValueError):
        motifs.find_motifs(spark.createDataFrame([(0, 1, 1, 7, 8, 42)], EVENTS), motifs.MotifSpec(tw=5, max_size=2), types)
    chain = spark.createDataFrame([(k, 3 * k, 3 * k, k, k + 1, 1) for k in range(6)], EVENTS)
    sizes = [len(r["ids"]) for r in motifs.find_sets(chain, motifs.MotifSpec(tw=5)).collect()]
    assert sorted(sizes) == sorted(n for n in range(1, 7) for _ in range(7 - n))


def test_long_chain(spark):
    edges = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components.connected(edges).agg(F.max("comp"), F.count("*")).first() == (0, 3001)


def test_weight_omission(spark):
    net = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 2), (4, 5, 7)], "src long, dst long, w long")
    assert {r["w"] for r in nullmodel.omit_heaviest(net, 0.25).collect()} == {1, 2}
    assert [tuple(r) for r in nullmodel.bin_limits(nullmodel.omit_heaviest(net, 0)).orderBy("bin").collect()] == [(0, 1, 2), (1, 2, 7), (2, 7, 8)]
    with pytest.raises(ValueError):
        nullmodel.omit_heaviest(net, 1.0)


def test_shuffles(spark, events, types):
    times = lambda df: sorted(r["start"] for r in df.collect())
    for out in (shuffles.shuffle_times(events, 3), shuffles.constrained_time_shuffle(events, 3), shuffles.biased_time_shuffle(events, 4, 3)):
        rows = out.collect()
        assert times(out) == times(events) and len(rows) == 22
        assert Counter((r["src"], r["dst"]) for r in rows) == Counter((r[3], r[4]) for r in fixture_rows())
        assert [r["event_id"] for r in sorted(rows, key=lambda r: r["event_id"])] == list(range(22))
    assert shuffles.overlapping(shuffles.constrained_time_shuffle(events, 3)).count() == 0
    assert sorted(r["ntype"] for r in shuffles.shuffle_node_types(types, 1).collect()) == [42, 42, 66, 66, 66]
    assert shuffles.faults(events).count() == 0


def test_queries(events, types):
    report = motifs.find_motifs(events, motifs.MotifSpec(tw=10, max_size=3), types)
    q = MotifQuery(n_events=[2], node_types=[42], node_policy="one", group_by="graph", top=2)
    rows = q.run(report).collect()
    assert rows and all(r["place"] <= 2 and len(r["events"]) == 2 for r in rows)
    merged = MotifQuery(type_map={66: 42}).filtered(report)
    assert {r["motif"]: r["count"] for r in merged.collect()}["[42,42] 0>1:1"] == 22
    levels = with_levels(report)
    same = levels.filter("motif_key = '[0,0,0] 0>1:1 1>2:1'").select("graph_key").distinct().collect()
    assert [r[0] for r in same] == ["[0,0,0] 0-1 0-2"]


def test_levels_of_six_nodes_and_more(spark):
    """Keys of large motifs: equal exactly where brute force over all orders finds forms isomorphic."""
    from itertools import permutations

    rnd = random.Random(3)

    def shuffled(edges, n):
        p = rnd.sample(range(n), n)
        return rnd.sample([(p[i], p[j]) for i, j in edges], len(edges))

    def named(edges):
        names = {}
        for e in edges:
            for x in e:
                names.setdefault(x, len(names))
        return [(names[i], names[j]) for i, j in edges]

    path, star = [(k, k + 1) for k in range(5)], [(0, k) for k in range(1, 6)]
    ring, two_rings = [(k, (k + 1) % 6) for k in range(6)], [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3)]
    prism = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)]
    k33 = [(i, j) for i in range(3) for j in range(3, 6)]
    shapes = [named(shuffled(s, 6)) for s in (path, star, ring, two_rings, prism, k33, [*path, (0, 1)]) for _ in range(3)]

    def least(edges, level):
        best = None
        for p in permutations(range(6)):
            x = [(p[i], p[j]) for i, j in edges]
            x = sorted(x) if level == "multigraph" else sorted(set(x)) if level == "digraph" else sorted({(min(e), max(e)) for e in x})
            best = x if best is None or x < best else best
        return tuple(best)

    motif = lambda edges, n=6: f"[{','.join('0' * n)}] {' '.join(f'{i}>{j}:1' for i, j in edges)}"
    rows = [(k, motif(s), 1) for k, s in enumerate(shapes)]
    report = spark.createDataFrame(rows, "k int, motif string, count long")
    got = sorted(with_levels(report).collect(), key=lambda r: r["k"])
    for level in ("multigraph", "digraph", "graph"):
        want = [least(s, level) for s in shapes]
        keys = [r[f"{level}_key"] for r in got]
        assert None not in keys
        for a in range(len(shapes)):
            for b in range(a):
                assert (keys[a] == keys[b]) == (want[a] == want[b]), (level, shapes[a], shapes[b])
    like = MotifQuery(like={"graph": [got[0]["graph_key"]]}, group_by="graph").run(report).collect()
    assert {r["k"] for r in like} == {k for k, s in enumerate(shapes) if least(s, "graph") == least(shapes[0], "graph")}
    # Very symmetric: a star of 30 leaves, and ten legs of two nodes.
    legs = [e for k in range(10) for e in ((0, 2 * k + 1), (2 * k + 1, 2 * k + 2))]
    big = [(31, [(0, k) for k in range(1, 31)]), (21, legs)]
    rows = [(motif(named(shuffled(e, n)), n), 1) for n, e in big for _ in range(3)]
    assert with_levels(spark.createDataFrame(rows, "motif string, count long")).select("graph_key", "digraph_key", "multigraph_key").distinct().count() == 2
