"""Token counts by a digest cache (operator 7).

A text's count depends on its content and on the tokenizer alone, so counts are
stored under the pair of digests. Content is normalised first: a space mark and
a space are the same to the tokenizer. A run joins its digests to the store,
encodes one representative of every digest that is missing, appends what it
found, and joins again. Texts that are stored, or that repeat, are never
encoded, and where all are stored, no text is read for more than its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import fresh_path, heavy_keys, materialize, share_package, ship, shipped, table, text_or_empty, tokenizer_path
from chronomotif.llm.pieces import MODEL, SPACE, encoder

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Part of the version digest; to change when the way of counting does.
RULES = "plain-2"
#: Missing digests up to which their table (50 bytes each) is sent to every task, and the texts stay where they are.
BROADCAST_MISSING = 1_000


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the rules of counting."""
    return hashlib.sha256(RULES.encode() + Path(path).read_bytes()).hexdigest()


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer in the cache, a row for each digest; empty where there is no cache yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == tokenizer)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    df: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    ``cache`` is a Parquet folder on shared storage that grows by the digests
    it lacked. A null text counts as empty, with no tokens; null ids and
    repeated rows give a row each; an empty table gives an empty result; other
    columns are neither read nor returned.
    """
    spark = df.sparkSession
    share_package(spark)
    path = model or tokenizer_path(MODEL)
    ship(spark, path)
    version = tokenizer_digest(path)
    texts = df.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2(F.replace("text", F.lit(SPACE), F.lit(" ")), 256)))
    content = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    # A row for each digest; a text that very many rows have is one row of it.
    distinct = materialize(content.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "digests")
    missing = distinct.join(stored_counts(spark, cache, version), "digest", "left_anti").select(F.col("digest").alias("wanted"), "first_id")
    n_missing = missing.count()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped(path))
        done: set[bytes] = set()  # rows that repeat an id with its text
        for batch in batches:
            digests, n = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in done:
                    done.add(digest)
                    digests.append(digest)
                    n.append(enc.count(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), pa.array(digests, pa.binary()), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    if n_missing:
        # The texts stream past a table of digests, unsorted.
        few = n_missing <= BROADCAST_MISSING
        wanted = F.broadcast(missing) if few else missing.hint("shuffle_hash")
        todo = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("wanted")), "left_semi")
        todo.select("digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    counts = stored_counts(spark, cache, version)
    heavy = heavy_keys(distinct, "digest", "rows")
    if heavy is None:
        known = content.join(counts, "digest")
    else:
        often = F.broadcast(counts.join(heavy, "digest", "left_semi"))
        known = content.join(often, "digest").unionByName(content.join(heavy, "digest", "left_anti").join(counts, "digest"))
    return known.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """The counts of all documents; without a ``cache`` that outlives the session they start from an empty one."""
    return count_tokens(table(spark, sf_dir, "documents"), cache or fresh_path(spark, "token-counts"))
