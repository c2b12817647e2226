"""Motifs in a partial order against all permutations, and labels of known orders."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from chronomotif.functions.canonical import canonical, key, parse
from chronomotif.functions.partial import order_labels, order_of, parse_order, partial_edge_labels, partial_key

SCHEMA = "id int, ntypes array<int>, events array<struct<i:int,j:int,c:int>>, `order` array<struct<a:int,b:int>>"


def _closed(n, order):
    after = set(order)
    while True:
        more = after | {(a, d) for a, b in after for c, d in after if b == c}
        if more == after:
            return after
        after = more


def _least(ntypes, events, order):
    """The least form over all orders of nodes and events."""
    closed = _closed(len(events), order)
    forms = []
    for p in permutations(range(len(ntypes))):
        types = [t for _, t in sorted(zip(p, ntypes))]
        for q in permutations(range(len(events))):
            rows = sorted((q[k], p[i], p[j], c) for k, (i, j, c) in enumerate(events))
            forms.append((types, rows, sorted((q[a], q[b]) for a, b in closed)))
    return min(forms)


def _drawn(rng, n_nodes, n_events):
    events = [(*rng.sample(range(n_nodes), 2), rng.randint(1, 2)) for _ in range(n_events)]
    line = rng.sample(range(n_events), n_events)
    order = [(line[a], line[b]) for a in range(n_events) for b in range(a + 1, n_events) if rng.random() < 0.4]
    return [rng.randint(0, 1) for _ in range(n_nodes)], events, order


def _renamed(rng, motif):
    ntypes, events, order = motif
    p, q = rng.sample(range(len(ntypes)), len(ntypes)), rng.sample(range(len(events)), len(events))
    rows = [None] * len(events)
    for k, (i, j, c) in enumerate(events):
        rows[q[k]] = (p[i], p[j], c)
    return [t for _, t in sorted(zip(p, ntypes))], rows, [(q[a], q[b]) for a, b in order]


def test_keys_part_exactly_what_permutations_part(spark):
    rng = random.Random(5)
    motifs = []
    for _ in range(60):
        m = _drawn(rng, rng.randint(2, 4), rng.randint(1, 4))
        motifs += [m, _renamed(rng, m)]
    rows = spark.createDataFrame([(k, *m) for k, m in enumerate(motifs)], SCHEMA)
    keys = {r.id: r.k for r in rows.select("id", partial_key(F.col("ntypes"), F.col("events"), F.col("order")).alias("k")).collect()}
    brute = [repr(_least(*m)) for m in motifs]
    assert len(set(zip(brute, keys.values()))) == len(set(brute)) == len(set(keys.values()))
    # A key read back is its own key.
    back = rows.select("id", partial_key(F.col("ntypes"), F.col("events"), F.col("order")).alias("k"))
    again = back.select("k", partial_key(*parse(F.col("k")), parse_order(F.col("k"))).alias("l"))
    assert again.filter("k <> l").count() == 0


def test_many_equal_events_without_order(spark):
    """Twelve equal pairs that nothing orders: the search doesn't try all their orders."""
    events = [(2 * k, 2 * k + 1, 1) for k in range(12)] + [(2 * k, 24, 1) for k in range(12)]
    order = [(k, 12 + k) for k in range(12)]
    mixed = _renamed(random.Random(1), ([0] * 25, events, order))
    rows = spark.createDataFrame([(0, [0] * 25, events, order), (1, *mixed)], SCHEMA)
    assert rows.select(partial_key(F.col("ntypes"), F.col("events"), F.col("order"))).distinct().count() == 1


def test_order_of_shared_nodes(spark):
    rows = [
        (0, [0] * 4, [(0, 1, 1), (2, 3, 1), (1, 2, 1)], []),  # two at once, then what joins them
        (1, [0] * 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1)], []),  # a chain
        (2, [0] * 4, [(0, 1, 1), (0, 2, 1), (1, 3, 1)], []),  # one, then two without order
        (3, [0] * 2, [(0, 1, 1)], []),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("o", order_of(F.col("events")))
    written = spark.createDataFrame(df.collect(), df.schema)
    got = {r.id: r for r in written.select("id", "o", order_labels(F.col("events")).alias("l"), F.array_join(partial_edge_labels(F.col("events"), F.col("o")), " ").alias("e")).collect()}
    orders = {k: [tuple(x) for x in r.o] for k, r in got.items()}
    both = written.select(partial_key(F.col("ntypes"), F.col("events")).alias("k"), partial_key(F.col("ntypes"), F.col("events"), F.col("o")).alias("l"))
    assert all(r.k == r.l for r in both.collect())
    assert orders == {0: [(0, 2), (1, 2)], 1: [(0, 1), (1, 2)], 2: [(0, 1), (0, 2)], 3: []}
    assert {k: r.l for k, r in got.items()} == {0: ["1a", "1b", "2ab"], 1: ["1", "2", "3"], 2: ["1", "2a", "2b"], 3: [""]}
    assert {k: r.e for k, r in got.items()} == {0: "0>1:1a 2>3:1b 1>2:2ab", 1: "0>1:1 1>2:2 2>3:3", 2: "0>1:1 0>2:2a 1>3:2b", 3: ""}


def test_labels_leave_out_what_follows(spark):
    """An arc that a longer way implies makes no branch; ten events of an edge go by rank."""
    rows = [(0, [0, 0], [(0, 1, 1)] * 3, [(0, 1), (1, 2), (0, 2)]), (1, [0, 0], [(0, 1, 1)] * 11, [(k, k + 1) for k in range(10)])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.e for r in df.select("id", F.array_join(partial_edge_labels(F.col("events"), F.col("order")), " ").alias("e")).collect()}
    assert got == {0: "0>1:1,2,3", 1: "0>1:" + ",".join(str(k) for k in range(1, 12))}


def test_level_of_order(spark):
    """Total orders that differ by chance are one at the level ``order``, apart at ``motif``."""
    rows = [(0, [5, 6, 7, 8], [(0, 1, 1), (2, 3, 2), (1, 2, 1)], []), (1, [7, 8, 5, 6], [(0, 1, 2), (2, 3, 1), (3, 0, 1)], [])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.select(canonical(F.col("ntypes"), F.col("events"), "order")).distinct().count() == 1
    assert df.select(key(F.col("ntypes"), F.col("events"))).distinct().count() == 2


def test_nulls_and_circles(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, [], [], [])], SCHEMA)
    got = {r.id: r.k for r in df.select("id", partial_key(F.col("ntypes"), F.col("events"), F.col("order")).alias("k")).collect()}
    assert got == {0: None, 1: "[] "}
    bad = spark.createDataFrame([(0, [0, 0], [(0, 1, 1), (0, 1, 1)], [(0, 1), (1, 0)])], SCHEMA)
    with pytest.raises(Exception, match="circle"):
        bad.select(partial_key(F.col("ntypes"), F.col("events"), F.col("order"))).collect()
