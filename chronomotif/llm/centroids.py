"""Centroid clustering of integer vectors with Hamerly's bounds (operator 13).

Each vector keeps an upper bound of the distance to its own centroid and one
lower bound of the distance to every other. When centroids move, the bounds are
loosened by their drifts. Where the upper bound stays below the lower one, or
below half the way from the own centroid to the nearest other, no other
centroid can be as near, and the vector isn't looked at. Where that can't be
told, the distance to the own centroid is taken anew, and where that doesn't
settle it either, all distances are, in whole numbers. Bounds are rounded
outwards, so that the result is that of full scans, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronomotif.llm.common import materialize, release, share_package, table

#: Components as whole numbers, up to which squared distances of 64 of them fit a long.
LARGEST = 2**27


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, q``: vectors of ``dims`` components, none null or non-finite, as ``floor(scale * x)``."""
    x = F.col("x").cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("x"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter((F.size("x") == dims) & finite).select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of their ids, in that order; those without an id come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "q").select("q").limit(k).collect()
    return np.array([r.q for r in rows], dtype=np.int64).reshape(len(rows), dims)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _root_up(squares: np.ndarray) -> np.ndarray:
    """Not below the root: whole numbers are rounded when they become doubles, and so is the root."""
    return _up(np.sqrt(_up(squares.astype(np.float64))))


def _root_down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(_down(np.sqrt(np.maximum(_down(squares.astype(np.float64)), 0))), 0)


def gaps(centroids: np.ndarray) -> np.ndarray:
    """By centroid, not above half the distance to the nearest other one."""
    squares = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    nearest = np.array([min((int(d) for j, d in enumerate(row) if j != i), default=-1) for i, row in enumerate(squares)])
    return np.where(nearest < 0, np.inf, _down(_root_down(np.maximum(nearest, 0)) / 2))


def drifts(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By centroid, not below how far it moved, and not below how far any other one did."""
    moved = _root_up(((after - before) ** 2).sum(1)) * ((after != before).any(1))
    others = np.array([max((m for j, m in enumerate(moved) if j != i), default=0.0) for i in range(len(moved))])
    return moved, others


def assigned(
    q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """New cluster, upper and lower bounds, and how many vectors were measured against their own centroid, and against all."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    known = cluster >= 0
    bound = np.where(known, np.maximum(lower, half[cluster]), -np.inf)
    open_ = np.flatnonzero(~(upper < bound))
    own = open_[known[open_]]
    upper[own] = _root_up(((q[own] - centroids[cluster[own]]) ** 2).sum(1))
    all_ = open_[~(upper[open_] < bound[open_])]
    if len(all_):
        squares = np.stack([((q[all_] - c) ** 2).sum(1) for c in centroids], axis=1)
        nearest = squares.argmin(1)  # the first of equals
        least = squares[np.arange(len(all_)), nearest]
        cluster[all_], upper[all_] = nearest, _root_up(least)
        if len(centroids) > 1:
            squares[np.arange(len(all_)), nearest] = np.iinfo(np.int64).max
            lower[all_] = _root_down(squares.min(1))
        else:
            lower[all_] = np.inf
    return cluster, upper, lower, len(own), len(all_)


def _state(id_type: T.DataType) -> T.StructType:
    """Rows of vectors; and, with ``of``, what a task's vectors have brought to a centroid: sums of components and a count."""
    longs = T.ArrayType(T.LongType())
    kinds = [("vec_id", id_type), ("q", longs), ("cluster", T.IntegerType()), ("upper", T.DoubleType()), ("lower", T.DoubleType()), ("of", T.IntegerType()), ("moved", longs), ("n", T.LongType())]
    return T.StructType([T.StructField(name, kind) for name, kind in kinds])


def _step(centroids: np.ndarray, drift: tuple[np.ndarray, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over a task's vectors: loosen the bounds, assign, and tell at the end what came to each centroid and left it."""
    half, dims = gaps(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        schema = None
        for batch in batches:
            n = batch.num_rows
            ids, q = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            if n and np.abs(q).max() > LARGEST:
                raise ArithmeticError(f"a vector has a component beyond {LARGEST}: squared distances would not fit a long")
            if drift is None:
                cluster, upper, lower = np.full(n, -1), np.full(n, np.inf), np.full(n, -np.inf)
            else:
                cluster, upper, lower = (batch.column(i).to_numpy() for i in (2, 3, 4))
                upper, lower = _up(upper + drift[0][cluster]), _down(lower - drift[1][cluster])
            new, upper, lower, _, _ = assigned(q, cluster, upper, lower, centroids, half)
            moved = np.flatnonzero(new != cluster)
            for j in range(len(centroids)):
                came, left = moved[new[moved] == j], moved[cluster[moved] == j]
                sums[j] += q[came].sum(0) - q[left].sum(0)
                counts[j] += len(came) - len(left)
            no_ints, no_longs = pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))
            columns = [ids, batch.column(1), pa.array(new, pa.int32()), pa.array(upper), pa.array(lower), no_ints, no_longs, pa.nulls(n, pa.int64())]
            out = pa.RecordBatch.from_arrays(columns, names=NAMES)
            schema = out.schema
            yield out
        touched = np.flatnonzero(counts.astype(bool) | sums.any(1))
        if len(touched):
            empty = [pa.nulls(len(touched), schema.field(i).type) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(touched, pa.int32()), pa.array(sums[touched].tolist(), pa.list_(pa.int64())), pa.array(counts[touched])], names=NAMES)

    return run


NAMES = ["vec_id", "q", "cluster", "upper", "lower", "of", "moved", "n"]


def _brought(state: DataFrame) -> dict[tuple[int, int], int]:
    """By centroid and component, and by centroid under -1 the count: sums over all tasks, k * (dims + 1) numbers."""
    rows = state.filter("of is not null")
    parts = rows.select("of", F.posexplode(F.concat("moved", F.array("n"))).alias("at", "value")).groupBy("of", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {(r.of, r.at): int(r.value) for r in parts.collect()}


def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that is kept.

    Kept are vectors of ``dims`` components, none null or non-finite. A vector
    without an id is kept, and starts a centroid only where too few have ids;
    repeated rows are vectors each; of fewer than ``k`` vectors each starts a
    centroid; equal centroids leave all to the smaller number; an empty centroid
    stays where it is. An empty table gives an empty result; other columns are
    not read. A component beyond 2^27 after scaling is refused, as distances
    would not fit.

    A round reads the vectors with their bounds and writes both; what leaves a
    task are sums over the vectors that changed, for each centroid.
    """
    spark = df.sparkSession
    share_package(spark)
    vectors = whole_vectors(df, id_col, vector_col, dims, scale)
    centroids = first_centroids(vectors, k, seed, dims)
    schema = _state(vectors.schema["vec_id"].dataType)
    if not len(centroids):
        return _result(spark.createDataFrame([], schema), centroids)
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    state = materialize(vectors.mapInArrow(_step(centroids, None), schema), "vectors")
    for _ in range(rounds):
        for (of, at), value in _brought(state).items():
            if at == dims:
                counts[of] += value
            else:
                sums[of][at] += value
        after = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums, counts, centroids.tolist(), strict=True)], dtype=np.int64)
        if (after == centroids).all():
            break  # every further round would find the same
        before, drift, centroids = state, drifts(centroids, after), after
        state = materialize(before.filter("of is null").select(*NAMES[:5]).mapInArrow(_step(centroids, drift), schema), "vectors")
        release(before)
    return _result(state, centroids)


def _result(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Exact distances to the last centroids; their sums by cluster, k rows, go to every task."""
    spark = state.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table_ = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(zip(centroids.tolist(), digests, strict=True))], "of int, centroid array<long>, centroid_sha256 string")
    rows = state.filter("of is null").select("vec_id", "q", "cluster").join(F.broadcast(table_), F.col("cluster") == F.col("of"))
    measured = rows.select("vec_id", "cluster", _squared("q", "centroid").alias("distance"), "centroid_sha256")
    sums = measured.groupBy(F.col("cluster").alias("of")).agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in sums)
    inertia = spark.createDataFrame([(r.of, r.cluster_inertia, total) for r in sums], "of int, cluster_inertia long, inertia long")
    out = measured.join(F.broadcast(inertia), F.col("cluster") == F.col("of"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same for DuckDB, each round with every distance: components as rows, a pair of common tables a round."""
    parts = [
        f"e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE len(embedding) = {dims}"
        " AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)",
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * c) AS BIGINT) for c in x] AS q FROM e)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS j, q AS c FROM v QUALIFY j < {k})",
    ]
    for t in range(rounds + 1):
        distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.q, c.c)])"
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, CAST({distance} AS BIGINT) AS d FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            parts.append(
                f"s{t} AS (SELECT j, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.j, v.q, unnest(range(1, {dims + 1})) AS i FROM a{t} a JOIN v USING (r)) GROUP BY j, i),"
                f" m{t} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{t} GROUP BY j),"
                f" c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{t} c LEFT JOIN m{t} m USING (j))"
            )
    last = f"""SELECT vec_id, CAST(a.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""
    return f"WITH {', '.join(parts)} {last}"


SQL = _sql()
