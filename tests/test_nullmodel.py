import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomotif.functions.canonical import count_text
from chronomotif.operators import cliques, network, nullmodel, shuffles
from chronomotif.plans import motifs
from chronomotif.sources.nets import Graph
from chronomotif.storage import saved

EVENTS = "event_id long, start long, end long, src long, dst long, etype int"


def random_events(seed, n=60, nodes=7):
    rnd = random.Random(seed)
    out, t = [], 0
    for k in range(n):
        a, b = rnd.sample(range(nodes), 2)
        t += rnd.randint(0, 4)
        out.append((k, t, t, a, b, rnd.choice([1, 2])))
    return out


@pytest.mark.parametrize("mixed,hypothesis,length", [*((m, h, 2) for m in (False, True) for h in (0, 1, 2)), (False, 0, 3), (True, 2, 3)])
def test_counted_places_are_the_made_ones(spark, mixed, hypothesis, length):
    """Totals from degrees against all sequences, with every pattern of two or three edges, opposite and parallel ones too."""
    events = spark.createDataFrame(random_events(3, n=60 if length == 2 else 22, nodes=7 if length == 2 else 5), EVENTS)
    types = spark.createDataFrame([(k, 10 + k % 3) for k in range(6)], "node long, ntype int")
    spec = motifs.MotifSpec(tw=6, max_size=length, references=0, allow_multiple_event_types=mixed, hypothesis=hypothesis, weight_omit=0.1)
    sets = motifs.find_sets(events, spec)
    made = saved(motifs.places_with_counts(events, sets, types, spec, length), "made")
    totals, hits = motifs.counted_places(events, sets, types, spec, length)
    by = ["motif", "ref_key", "bins"]
    want = {(r["motif"], r["ref_key"], tuple(r["bins"])): r["n"] for r in made.groupBy(*by).agg(F.count("*").alias("n")).collect()}
    assert {(r["motif"], r["ref_key"], tuple(r["bins"])): r["n"] for r in totals.groupBy(*by).agg(F.sum("n").alias("n")).collect()} == want
    found = Counter((r["motif"], r["ref_key"], tuple(r["bins"]), r["cnt"]) for r in made.filter("cnt > 0").collect())
    assert Counter((r["motif"], r["ref_key"], tuple(r["bins"]), r["cnt"]) for r in hits.collect()) == found
    patterns = {m.split("] ")[1].replace(":1", "").replace(":2", "") for m, _, _ in want}
    assert len(patterns) == 7 if length == 2 else len(patterns) > 60


def test_three_edges_of_the_null_model(spark):
    """Exact expectations over places of three edges: their sum is that of the counts, type by type."""
    events = spark.createDataFrame(random_events(5, n=25, nodes=6), EVENTS)
    spec = motifs.MotifSpec(tw=6, max_size=3, references=0, hypothesis=2)
    rows = motifs.find_motifs(events, spec).collect()
    plain = lambda m: "".join(c for c in m.replace(":2", ":1"))
    counts, expected = Counter(), Counter()
    for r in rows:
        if r["ref_avg"] is None:  # in no order in which each edge meets one before
            continue
        counts[plain(r["motif"])] += r["count"]
        expected[plain(r["motif"])] += r["ref_avg"]
    assert any(k.count(">") == 3 and v for k, v in counts.items())
    for k in expected:
        assert expected[k] == pytest.approx(counts[k])


def test_references_by_cell_follow_the_histogram(spark):
    """A cell of 40 places, a quarter with one event and a tenth with three: mean, variance and hits of 4000 references; the same again by the same seed."""
    cells = spark.createDataFrame([("k", [0], 0, 26), ("k", [0], 1, 10), ("k", [0], 3, 4)], "ref_key string, bins array<int>, value long, n long")
    alike = spark.createDataFrame([("k", [0], "a", 30, 3), ("k", [0], "b", 10, 1)], "ref_key string, bins array<int>, motif string, places long, hit long")
    draw = lambda seed, parts: sorted(tuple(r) for r in nullmodel.drawn_by_cell(alike.repartition(parts), cells, 4000, seed).collect())
    rows = draw(7, 1)
    assert rows == draw(7, 3) != draw(8, 1)
    mean, var = 22 / 40, 46 / 40 - (22 / 40) ** 2
    for motif, places in (("a", 30), ("b", 10)):
        totals = np.array([t for m, _, t, _ in rows if m == motif])
        hits = np.array([h for m, _, _, h in rows if m == motif])
        assert len(totals) == 4000 and abs(totals.mean() - places * mean) < 5 * (places * var / 4000) ** 0.5
        assert totals.var() == pytest.approx(places * var, rel=0.15) and hits.mean() == pytest.approx(places * 14 / 40, rel=0.05)
        assert (totals >= hits).all()


def test_sets_of_any_size(spark):
    events = spark.createDataFrame(random_events(8, n=12, nodes=5), EVENTS)
    all_sizes = motifs.find_sets(events, motifs.MotifSpec(tw=3, max_size=0))
    capped = motifs.find_sets(events, motifs.MotifSpec(tw=3, max_size=12))
    ids = lambda df: {tuple(r["ids"]) for r in df.collect()}
    assert ids(all_sizes) == ids(capped) and max(map(len, ids(all_sizes))) >= 3
    with pytest.raises(ValueError):
        motifs.MotifSpec(tw=3, max_size=-1)


def test_chains_of_swaps(spark):
    rnd = random.Random(2)
    rows = [(k, 10 * k, 10 * k + 3, *rnd.sample(range(12), 2), 1 + k % 2) for k in range(40)]
    events = spark.createDataFrame(rows, EVENTS)
    for out in (shuffles.constrained_time_shuffle(events, 1), shuffles.biased_time_shuffle(events, 4, 1)):
        got = out.orderBy("event_id").collect()
        assert [r["event_id"] for r in got] == list(range(40))
        assert Counter((r["start"], r["end"], r["etype"]) for r in got) == Counter((s, e, t) for _, s, e, _, _, t in rows)
        assert Counter((r["src"], r["dst"], r["etype"]) for r in got) == Counter((a, b, t) for _, _, _, a, b, t in rows)
        assert sum((r["start"], r["src"], r["dst"]) in {(s, a, b) for _, s, _, a, b, _ in rows} for r in got) < 30
        assert shuffles.overlapping(out).count() == 0
    stuck = spark.createDataFrame([(0, 0, 100, 1, 2, 1), (1, 50, 150, 1, 3, 1), (2, 60, 70, 1, 4, 1)], EVENTS)
    with pytest.raises(Exception, match="leave no overlap"):
        shuffles.constrained_time_shuffle(stuck, 1).collect()


def test_faults_by_order(spark):
    rows = [(0, 5, 6, 1, 2, 1), (1, 4, 6, 1, 2, 1), (2, 8, 7, 1, 1, 1), (3, 9, 9, 1, 2, 1), (3, 9, 9, 1, 2, 1)]
    got = Counter((r["event_id"], r["fault"]) for r in shuffles.faults(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == Counter({(1, "out of order"): 1, (2, "loop"): 1, (2, "ends before it starts"): 1, (3, "repeated id"): 2})


def test_percolation_points(spark, monkeypatch):
    g = Graph.of(spark.createDataFrame([(1, 2, 3.0), (2, 3, 1.0), (1, 3, 2.0)], "u long, v long, w double"))
    assert cliques.evaluations(g) == [1.0, 2.0, 3.0]
    monkeypatch.setattr(cliques, "MOST_POINTS", 2)
    with pytest.raises(ValueError):
        cliques.evaluations(g)


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(7,), (9_999,), (10_000,), (12_345,), (2_000_000,), (2_345_678,)], "n long")
    assert [r[0] for r in df.select(count_text(F.col("n"))).collect()] == ["7", "9999", "10k", "12.3k", "2M", "2.3M"]


def test_place_totals_refuses_longer_places(spark):
    with pytest.raises(ValueError):
        network.place_totals(spark.createDataFrame([], "src long, dst long, etype int, bin int, st int, dt int"), 4)
