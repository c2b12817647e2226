"""What the two classifiers share: folds, and a labelled sample of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
FOLDS = 5


def fold(id_col: str | Column) -> Column:
    """A row's fold, from its id; fold 0 is held out. Rows without an id have none."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(c.cast("string")) % FOLDS).cast("int")


def held_out(id_col: str | Column) -> Column:
    """Whether a row belongs to the fold that no label is learned from."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, label, fold`` of at most ``rows`` labelled documents outside the held-out fold; of texts under one id, the least."""
    known = labels.filter(~held_out("doc_id") & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "known_id")
    texts = docs.select(F.col("doc_id").alias("of_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = texts.join(F.broadcast(known), F.col("of_id") == F.col("known_id")).groupBy("of_id", "label").agg(F.min("text").alias("text"))
    return one.select("text", "label", fold("of_id").alias("fold"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, by Newton steps; a constant where only one class is there."""
    n, d = x.shape
    w = np.zeros(d + 1)
    if n == 0:
        w[-1] = -3.0
        return w
    rate = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    z = np.hstack([x, np.ones((n, 1))])
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
