"""A corpus pipeline: documents to token ids, in stages that are each an operator of ``chronomotif.llm``.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm import mixing, ngram_join, pieces, secrets, toxicity
from chronomotif.llm.common import materialize, table

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the bound; the model learns from labelled documents among them.

    Null texts score as empty ones; rows that repeat an id are scored each.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out_col="toxicity_score")
    return scored.filter(F.col("toxicity_score") < TOXIC_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents, the one with the smallest id; documents without words stay.

    Rows that repeat an id are one document: one row for each of its texts
    stays. Rows without an id are no document's copies, and stay.
    """
    groups = ngram_join.ngram_components(docs)
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("gone_id"), "left_anti").select(docs.columns)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("repeated_id"))
    if not repeated.limit(1).count():
        return kept
    same = F.col("doc_id") == F.col("repeated_id")
    often = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(often.select(docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what was found replaced by a mark, and their lengths as they then are; null texts stay null."""
    found = secrets.find_secrets(docs, out_col="found_secrets")
    text = F.when(F.col("text").isNotNull(), secrets.redact(F.col("text"), F.col("found_secrets")))
    clean = found.withColumn("text", text)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, a row for each time; null sources are one source."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and digests of them and of what they decode to; a null text is the end id alone."""
    return pieces.encode_decode(docs).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Models and token automata are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
