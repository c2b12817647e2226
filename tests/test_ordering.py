import random

import pytest
from pyspark.sql import functions as F

from chronomotif.functions import ordering
from chronomotif.operators import adjacency, components, subgraphs

EVENTS = "event_id long, start long, end long, src long, dst long, etype int"


def hub_events(n=900, seed=4):
    """Nine of ten events at node 0; some repeat a pair with others between."""
    rnd = random.Random(seed)
    out, t = [], 0
    for k in range(n):
        t += rnd.randint(0, 3)
        a, b = (0, rnd.randint(1, 30)) if k % 10 else rnd.sample(range(1, 31), 2)
        out.append((k, t, t, *((a, b) if rnd.random() < 0.5 else (b, a)), 1))
    return out


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 60)
    monkeypatch.setattr(ordering, "SLICES", 16)


def test_neighbours_of_a_sliced_hub(spark, small_slices):
    rows = hub_events()
    events = spark.createDataFrame(rows, EVENTS)
    got = {(r["node"], r["event_id"]): (r["place"], r["before"], r["after"]) for r in adjacency.node_index(events).collect()}
    want = {}
    for node in range(31):
        own = [k for k, _, _, a, b, _ in rows if node in (a, b)]
        for i, k in enumerate(own):
            want[node, k] = (i + 1, own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None)
    assert got == want


def test_slices_are_even(spark, small_slices):
    """The hub's 840 rows are cut so that no slice has twice the mean, and no rows are lost."""
    rows = adjacency.node_events(spark.createDataFrame(hub_events(), EVENTS)).select("node", "event_id")
    cuts = ordering.slices(rows, ["node"], "event_id").collect()
    hub = sorted(r["event_id"] for r in rows.filter("node = 0").collect())
    (found,) = cuts
    assert found["node"] == 0
    sizes = [sum(lo < k <= hi for k in hub) for lo, hi in zip([-1, *found["_at"]], [*found["_at"], 10**9], strict=True)]
    assert sum(sizes) == len(hub) and len(sizes) >= 7 and max(sizes) <= 2 * len(hub) / len(sizes)


@pytest.mark.parametrize("tw", [2, 40])
def test_sliced_and_whole_windows_agree(spark, monkeypatch, tw):
    events = spark.createDataFrame(hub_events(300), EVENTS)

    def run():
        pairs = adjacency.within(adjacency.next_events(events), tw)
        comp = components.maximal_subgraphs(events, tw, pairs)
        sets = subgraphs.valid_sets(events, pairs, comp, 2)
        places = subgraphs.ranked_nodes(events, comp)
        return tuple(sorted(map(str, df.collect())) for df in (pairs, sets.select("ids", "gap"), places.orderBy("node", "event_id")))

    whole = run()
    monkeypatch.setattr(ordering, "SLICE_ROWS", 20)
    monkeypatch.setattr(ordering, "SLICES", 64)
    assert run() == whole


def test_order_of_nothing_and_of_odd_columns(spark, small_slices):
    none = spark.createDataFrame([], "k string, o long, v string")
    assert ordering.in_order(none, ["k"], "o", ["v"], ["v"], "at").count() == 0
    rows = spark.range(400).select(F.lit("x").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 2 == 0, "even").alias("v"))
    got = ordering.in_order(rows, ["k"], "o", ["v", "o"], ["v"], "at").orderBy("o").collect()
    assert [r["at"] for r in got] == list(range(1, 401)) and [r["next_o"] for r in got] == [*range(1, 400), None]
    assert [r["next_v"] for r in got] == [None if k % 2 == 0 or k == 399 else "even" for k in range(400)]
    assert [r["prev_v"] for r in got] == [None if k % 2 == 0 else "even" for k in range(400)]
