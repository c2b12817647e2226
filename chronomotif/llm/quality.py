"""Quality by a factorisation machine (operator 6).

The inputs of a text are its hashed words, weighted by how often they occur,
statistics of its structure, and of its metadata the sizes (words, lines,
characters a word); language, source and id are no inputs. The machine has a weight for every
input and a low-rank vector for every input, whose products weigh pairs; the
sum over all pairs is taken in linear time, as half the difference of the
squared sums and the sums of squares.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import share_package, table
from chronomotif.llm.learning import held_out, training_texts

BUCKETS = 4096
RANK = 8
EPOCHS, BATCH, RATE = 8, 256, 0.03
#: Labelled rows that the machine is fitted on at most; a row has no more inputs than there are buckets and statistics.
SAMPLE_ROWS = 10_000
WORDS_KEPT = 500_000
STATISTICS = (
    "log_words", "word_length", "upper", "symbols", "digits", "beyond_ascii", "distinct", "top_word", "same_as_before",
    "bars", "exclamations", "stops", "line_words", "repeated_lines", "long_words", "odd_ends", "log_lines", "one_letter",
)
INPUTS = BUCKETS + len(STATISTICS)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return h


_hashes = _Hashes()
_SYMBOLS = str.maketrans("", "", "#$%&*+/<=>@[\\]^_`{|}~")
_DIGITS = str.maketrans("", "", "0123456789")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞÑ]")


def inputs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a text's words, their weights, of length 1 together, and the statistics."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    counts = Counter(words)
    lines = text.split("\n")
    low: Counter[int] = Counter()
    for w, times in counts.items():
        low[_hashes[w.lower()]] += times
    idx = np.fromiter(low.keys(), np.int32, len(low))
    val = np.sqrt(np.fromiter(low.values(), np.float64, len(low)))
    val /= max(np.sqrt((val * val).sum()), 1e-9)
    m = max(n, 1)
    after = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stats = [
        np.log1p(n),
        size / m,
        len(_UPPER.findall(text)) / size,
        (len(text) - len(text.translate(_SYMBOLS))) / size,
        (len(text) - len(text.translate(_DIGITS))) / size,
        (len(text.encode("utf-8", "surrogatepass")) - len(text)) / size,
        len(counts) / m,
        max(counts.values(), default=0) / m,
        after / m,
        text.count("|") / m,
        text.count("!") / m,
        text.count(".") / m,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if len(w) > 15) / m,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,") / m,
        np.log1p(len(lines)),
        sum(c for w, c in counts.items() if len(w) == 1) / m,
    ]
    return idx, val.astype(np.float32), np.array(stats)


class Model:
    """A factorisation machine over hashed words and standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, rate: float, seed: int = 7):
        self.centre, self.scale = centre, scale
        self.w = np.zeros(INPUTS)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (INPUTS, RANK))
        self.w0 = float(np.log(rate / (1 - rate)))

    def joined(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of several texts, one after the other: which, how much, and where each text begins."""
        s = np.clip((np.array([r[2] for r in rows]) - self.centre) / self.scale, -4, 4) / 2
        which = np.concatenate([np.concatenate([r[0], np.arange(BUCKETS, INPUTS)]) for r in rows])
        much = np.concatenate([np.concatenate([r[1], s[k]]) for k, r in enumerate(rows)])
        return which, much, np.append(0, np.cumsum([len(r[0]) + len(STATISTICS) for r in rows]))[:-1]

    def raw(self, which: np.ndarray, much: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's values, and the sums of factors that the pairs come from."""
        vx = self.v[which] * much[:, None]
        sums = np.add.reduceat(vx, begins)
        pairs = 0.5 * (sums * sums - np.add.reduceat(vx * vx, begins)).sum(1)
        return self.w0 + np.add.reduceat(self.w[which] * much, begins) + pairs, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        out = []
        for k in range(0, len(texts), BATCH):
            out.append(self.raw(*self.joined([inputs(t) for t in texts[k : k + BATCH]]))[0])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.empty(0)


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, by steps scaled by the history of each weight's gradients."""
    n = len(rows)
    stats = np.array([r[2] for r in rows]) if n else np.zeros((1, len(STATISTICS)))
    model = Model(stats.mean(0), stats.std(0) + 1e-6, (y.sum() + 0.5) / (n + 1), seed)
    if n == 0 or y.min() == y.max():
        model.v[:] = 0
        return model
    gw, gv = np.full(INPUTS, 1e-3), np.full((INPUTS, RANK), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            part = order[k : k + BATCH]
            which, much, begins = model.joined([rows[i] for i in part])
            value, sums = model.raw(which, much, begins)
            error = 1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[part]
            lengths = np.diff(np.append(begins, len(which)))
            e = np.repeat(error, lengths) * much
            dw, dv = np.zeros(INPUTS), np.zeros((INPUTS, RANK))
            np.add.at(dw, which, e)
            each = e[:, None] * (np.repeat(sums, lengths, 0) - model.v[which] * much[:, None])
            for f in range(RANK):
                dv[:, f] = np.bincount(which, each[:, f], INPUTS)
            dw, dv = dw / len(part) + 1e-4 * model.w, dv / len(part) + 1e-4 * model.v
            gw += dw * dw
            gv += dv * dv
            model.w -= RATE * 3 * dw / np.sqrt(gw)
            model.v -= RATE * dv / np.sqrt(gv)
            model.w0 -= RATE * error.mean()
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The machine, from a bounded sample of labelled rows outside the held-out fold."""
    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [inputs(t.as_py()) for t in batch.column(0)]
            cols = [pa.array([r[k].tobytes() for r in x], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(1)], names=["a", "b", "c", "label"])

    rows = training_texts(docs, labels, "quality", SAMPLE_ROWS).mapInArrow(run, "a binary, b binary, c binary, label int").collect()
    rows.sort(key=lambda r: (bytes(r["c"]), bytes(r["a"]), r["label"]))  # whatever the order in which tasks end
    x = [(np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.float32), np.frombuffer(r["c"], np.float64)) for r in rows]
    return train(x, np.array([r["label"] for r in rows], float))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: 0 to 1, a null text as an empty one.

    Null ids and repeated rows have a row each, equal texts score alike; an
    empty table gives an empty result; other columns are not read.
    """
    share_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(model)  # of one size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores([t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
