import random

import pytest

from chronomotif.operators import adjacency, components, subgraphs

EVENTS = "event_id long, start long, end long, src long, dst long, etype int"


@pytest.mark.parametrize("seed,nodes,tw,time_gap", [(1, 4, 6, 0), (2, 6, 3, 0), (3, 3, 9, 0), (4, 9, 12, 5), (5, 5, 0, 0)])
def test_sets_from_neighbours_are_the_grown_ones(spark, seed, nodes, tw, time_gap):
    """Stars, paths, parallel events and triangles; few nodes, so that events share both."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for k in range(120):
        t += rnd.randint(0, 4)
        rows.append((k, t, t + rnd.randint(0, 1), *rnd.sample(range(nodes), 2), rnd.choice([1, 2])))
    events = spark.createDataFrame(rows, EVENTS)
    adjacent = adjacency.within(adjacency.next_events(events), tw)
    comp = components.maximal_subgraphs(events, tw, adjacent)
    for size in (1, 2, 3):
        grown = subgraphs.connected_sets(adjacency.in_window(events, time_gap), adjacent, size)
        want = subgraphs.described(grown, events, subgraphs.ranked_nodes(events, comp)).filter("valid").drop("valid")
        got = subgraphs.near_sets(events, adjacent, comp, size, time_gap)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    adjacent = adjacency.next_events(none)
    assert subgraphs.near_sets(none, adjacent, components.maximal_subgraphs(none, 3, adjacent), 3).count() == 0
