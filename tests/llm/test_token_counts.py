import pytest

from chronomotif.llm import common, token_counts
from chronomotif.llm.common import fresh_path, tokenizer_path
from chronomotif.llm.pieces import MODEL, encoder
from chronomotif.llm.token_counts import count_tokens, op7_token_counts


def test_counts_and_cache(spark):
    enc = encoder(tokenizer_path(MODEL)).library
    rows = [(1, "the cat", "n"), (2, "the cat", "n"), (3, None, "n"), (4, "", "n"), (None, "é " * 3000, "n"), (None, "other", "n"), (5, "the cat", "n"), (5, "the cat", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    cache = fresh_path(spark, "cache")
    out = count_tokens(df, cache, limit=100).collect()
    assert len(out) == len(rows)
    want = sorted(str((i, len((t or "").encode()), len(enc.encode(t or "")), len(enc.encode(t or "")) > 100)) for i, t, _ in rows)
    assert sorted(str(tuple(r)) for r in out) == want
    first = spark.read.parquet(cache).select("digest").distinct().count()
    assert first == 4
    more = df.unionByName(spark.createDataFrame([(9, "new text", "n")], df.schema))
    again = count_tokens(more, cache, limit=100)
    assert again.count() == len(rows) + 1
    assert spark.read.parquet(cache).select("digest").distinct().count() == first + 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(df, fresh_path(spark, "cache")).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1_000])
def test_repeated_texts_are_encoded_once(spark, monkeypatch, broadcast):
    """One text in a third of all rows, and a space mark in place of a space: one row of the cache each, right counts everywhere."""
    monkeypatch.setattr(token_counts, "BROADCAST_MISSING", broadcast)
    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    enc = encoder(tokenizer_path(MODEL)).library
    rows = [(k, "the same text") for k in range(40)] + [(100 + k, f"text number {k}") for k in range(60)] + [(7, "the same text"), (300, "a b"), (301, "a\u2581b"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cache = fresh_path(spark, "cache")
    out = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, cache).collect()), key=str)
    assert out == sorted(((i, len(t.encode()), len(enc.encode(t))) for i, t in rows), key=str)
    assert spark.read.parquet(cache).count() == 62 == spark.read.parquet(cache).select("digest").distinct().count()


def test_query_with_a_warm_cache_encodes_nothing(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k % 30} é") for k in range(90)] + [(500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cache = str(tmp_path / "cache")
    first = op7_token_counts(spark, str(tmp_path), cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 31
    monkeypatch.setattr(token_counts, "encoder", lambda path: None)
    assert sorted(map(tuple, op7_token_counts(spark, str(tmp_path), cache).collect())) == sorted(map(tuple, first))
    assert spark.read.parquet(cache).count() == 31
