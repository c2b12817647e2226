import hashlib
import random

import numpy as np
import pytest

from chronomotif.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q int"


def brute(rows, k, rounds, dims):
    """Lloyd's rounds with every distance, in Python's whole numbers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [int(np.floor(1024 * float(np.float32(c)))) for c in x]))
    mark = lambda v: hashlib.sha256(f"3:{v}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else mark(r[0]), r[1]))[:k]
    at = [q for _, q in first]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min(range(len(at)), key=lambda j: (squared(q, at[j]), j))
    for _ in range(rounds):
        groups = [[] for _ in at]
        for _, q in kept:
            groups[nearest(q)].append(q)
        at = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else old for g, old in zip(groups, at, strict=True)]
    found = [(v, nearest(q), squared(q, at[nearest(q)])) for v, q in kept]
    by = {j: sum(d for _, c, d in found if c == j) for j in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted((str(v), c, d, by[c], sum(by.values()), digest[c]) for v, c, d in found)


def rows_of(seed, n, dims, ties):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    out = []
    for k in range(n):
        if ties:  # few values: equal distances and equal vectors
            x = [rnd.choice([0.0, 0.5, -0.5]) for _ in range(dims)]
        else:
            c = rnd.choice(centres)
            x = [v + rnd.gauss(0, 0.3) for v in c]
        out.append((k, x))
    return out


@pytest.mark.parametrize("seed,ties,dims,k", [(1, False, 64, 8), (2, True, 3, 8), (3, True, 64, 8), (4, False, 2, 5), (5, False, 64, 1)])
def test_bounds_give_the_result_of_full_scans(spark, seed, ties, dims, k):
    rows = rows_of(seed, 160, dims, ties)
    odd = [(900, None), (901, [0.1] * (dims - 1)), (902, [*[0.1] * (dims - 1), None]), (903, [*[0.1] * (dims - 1), float("nan")]), (904, [*[0.1] * (dims - 1), float("-inf")]), (None, [0.3] * dims), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(v, x, 1, "c", 2) for v, x in rows + odd], SCHEMA).repartition(3)
    got = centroids.cluster_vectors(df, k=k, dims=dims).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == brute(rows + odd, k, 10, dims)


def test_few_vectors_and_none(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, [1.0] * 64), (6, [2.0] * 64)]
    got = centroids.cluster_vectors(spark.createDataFrame([(v, x, 1, "c", 2) for v, x in rows], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in got) == [(5, 0, 0), (6, 0, 0)] and len({r["cluster"] for r in got}) == 2


def test_components_that_are_too_large(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 1, "c", 2)], SCHEMA)
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster_vectors(df).collect()


def test_most_vectors_are_not_measured():
    """After a small drift, vectors near their centroid need neither their own distance nor a scan; the others get what a scan gives."""
    rng = np.random.default_rng(1)
    at = rng.integers(-1000, 1000, (8, 64))
    q = at[rng.integers(0, 8, 5000)] + rng.integers(-60, 60, (5000, 64))
    cluster, upper, lower, _, scanned = centroids.assigned(q, np.full(5000, -1), np.full(5000, np.inf), np.full(5000, -np.inf), at, centroids.gaps(at))
    assert scanned == 5000
    after = at + rng.integers(-3, 4, at.shape)
    moved, others = centroids.drifts(at, after)
    upper, lower = np.nextafter(upper + moved[cluster], np.inf), np.nextafter(lower - others[cluster], -np.inf)
    new, up, low, measured, scanned = centroids.assigned(q, cluster, upper, lower, after, centroids.gaps(after))
    squares = ((q[:, None, :] - after[None]) ** 2).sum(2)
    assert (new == squares.argmin(1)).all() and measured < 500 and scanned < 100
    true = np.sqrt(squares)
    assert (up >= true[np.arange(5000), new]).all()
    true[np.arange(5000), new] = np.inf
    assert (low <= true.min(1)).all()
