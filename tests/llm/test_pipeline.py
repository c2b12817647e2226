import random

import corpus_pipeline
from chronomotif.llm import mixing
from chronomotif.llm.common import materialize, tokenizer_path
from chronomotif.llm.pieces import MODEL, encoder


def test_stages(spark, tmp_path):
    rnd = random.Random(4)
    words = [a + b for a in "ba de fi go lu mi na po".split() for b in "rt sk ll nd mb st".split()]
    docs, labels = [], []
    for k in range(160):
        w = [rnd.choice(words) for _ in range(rnd.randint(8, 60))]
        if k % 8 == 0:
            w[3:3] = ["zugnut"] * 3
        docs.append((k, " ".join(w), "en", f"s{k % 4}", 0))
        labels.append((k, 1, int(k % 8 == 0)))
    docs.append((500, docs[1][1], "en", "s1", 0))
    docs.append((501, docs[2][1] + " end", "en", "s2", 0))
    docs[3] = (3, docs[3][1] + " password=abcdefabcdefabcdef0", "en", "s3", 0)
    docs.append((502, None, None, None, None))
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    at = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, materialize(stage(spark, at, path))
        seen.append((name, before, at))
    assert all(x[2].columns == x[1].columns for x in seen[:-1])
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(seen[0][2]) == {d[0] for d in docs} - {k for k in range(0, 160, 8)}
    assert ids(seen[1][2]) == ids(seen[0][2]) - {500, 501}
    assert ids(seen[2][2]) == ids(seen[1][2])
    text = seen[2][2].filter("doc_id = 3").first()
    assert text["text"].endswith(" [SECRET]") and text["n_chars"] == len(text["text"])
    times = {r["doc_id"]: r["times"] for r in mixing.mix_sources(seen[2][2]).collect()}
    counts = {}
    for r in seen[3][2].collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {k: n for k, n in times.items() if n}
    enc = encoder(tokenizer_path(MODEL))
    kept = {r["doc_id"]: r["text"] for r in seen[3][2].collect()}
    for r in seen[4][2].collect():
        assert r["ids"] == [*enc.library.encode(kept[r["doc_id"]] or ""), enc.eos]
    assert corpus_pipeline.run(spark, path).count() == seen[4][2].count()


def test_odd_tables(spark, tmp_path):
    """No documents; then nulls everywhere, repeated rows, a very long text, and columns that have the operators' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, times long, secrets string, codes int"
    for name, rows in (
        ("none", []),
        ("odd", [(1, "a b c d e f g", "en", "x", 0, 1, "s", 2)] * 2 + [(1, "another text of id one here", None, None, None, None, None, None), (2, "A b c d e f g", "en", None, 0, 1, "s", 2), (None, "a b c d e f g", "en", "x", 0, 1, "s", 2), (None, None, None, None, None, None, None, None), (3, "", "en", "x", 0, 1, "s", 2), (4, "long words " * 60_000, "en", "y", 0, 1, "s", 2)]),
    ):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        at = spark.read.parquet(f"{path}/documents.parquet")
        kept = []
        for _, stage in corpus_pipeline.STAGES:
            at = materialize(stage(spark, at, path), "odd")
            kept.append(at)
        if not rows:
            assert all(k.count() == 0 for k in kept)
            continue
        assert all(k.columns == kept[0].columns for k in kept[:-1])
        left = sorted((str(r["doc_id"]), str(r["text"])[:30]) for r in kept[1].collect())
        assert left == sorted([("1", "a b c d e f g"), ("1", "another text of id one here"), ("None", "a b c d e f g"), ("None", "None"), ("3", ""), ("4", ("long words " * 3)[:30])])
        assert kept[2].count() == len(left)
