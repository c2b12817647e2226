import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomotif.llm import quality, toxicity

CLEAN = "the river bends past fields and small towns where people work in spring light".split()


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(9)
    docs, labels = [], []
    for k in range(600):
        w = [rnd.choice(CLEAN) + rnd.choice(["", "s", "er", "ing"]) for _ in range(rnd.randint(5, 60))]
        toxic, good = k % 5 == 0, k % 4 != 1
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["blortish", "zugnut"]) + rnd.choice(["", "s"]))
        text = " ".join(w) + "."
        docs.append((k, text if good else " ".join(x.upper() + "!!" for x in w), "en"))
        labels.append((k, int(good), int(toxic)))
    return (
        spark.createDataFrame(docs + [(1000, None, "en"), (1001, "", "en"), (None, "the river", "en"), (5, docs[5][1], "en")], "doc_id long, text string, score string"),
        spark.createDataFrame(labels + [(None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int"),
        {k: (t, q) for k, q, t in labels},
    )


def test_toxicity_held_out(tables):
    docs, labels, truth = tables
    model = toxicity.fit(docs, labels)
    assert any(w.startswith("blort") for w in model[0]) and not any(c.startswith(w) for w in model[0] for c in CLEAN)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 604 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]][0] for r in held]) > 0.97


def test_grammar_reads_context():
    s = toxicity.Scorer({"blort": 5.0})
    f = lambda text: {k for k, v in zip(toxicity.FEATURES, s.features(toxicity.lowered(text)), strict=True) if v and k in toxicity.ARCS}
    assert f("a blortish thing") == {"insult"}
    assert f("you are a blortish thing") == f("a blortish thing, you see") == f("BLOOOORT you") == {"insult_targeted"}
    assert f("not a blortish thing") == {"insult_negated"} and f("not one of all the many blortish") == {"insult"}
    assert f("she said blortish things") == f('"you blort" she said') == f('"You blort!" she said.') == {"insult_reported"}
    assert f("I will kill it") == {"threat"} and f("I will kill you") == {"threat_targeted"} and f("kill it") == set() == f("I will not kill it")
    assert f("enblortish words. clean") == set()
    assert f("you see. A blort") == {"insult"}
    assert f("you blort. not a blort") == {"insult_targeted", "insult_negated"}
    assert s.features("") == s.features("nothing here at all") == [0.0] * len(toxicity.FEATURES)
    assert s.features("clean. " * 50_000 + "you blort")[-1] == pytest.approx(1 / 50_001)


def test_composition_matches_plain_reading():
    """The composed tables against definitions read straight off each clause."""
    rnd, g = random.Random(5), toxicity.Grammar()
    for _ in range(3_000):
        x = [rnd.choice(toxicity.SYMBOLS) for _ in range(rnd.randint(0, 14))]
        want = []
        for k, c in enumerate(x):
            negated, intent = "N" in x[max(0, k - toxicity.NEGATION_REACH) : k], "W" in x[max(0, k - toxicity.INTENT_REACH) : k]
            rest = x[:k] + x[k + 1 :]
            if c == "I":
                want.append((k, "insult_negated" if negated else "insult_reported" if "R" in rest else "insult_targeted" if "T" in rest else "insult"))
            if c == "V" and intent and not negated:
                want.append((k, "threat_reported" if "R" in rest else "threat_targeted" if "T" in x[k + 1 :] else "threat"))
        assert g.matches(x) == want


def test_toxicity_ignores_held_out_labels(spark, tables):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a[0] == b[0] and np.allclose(a[1], b[1])


def test_quality_held_out(tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 604 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.3) == truth[r["doc_id"]][1] for r in held]) > 0.95


def test_pairs_in_linear_time():
    m = quality.Model(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)), 0.5)
    m.w = np.random.default_rng(1).normal(size=quality.INPUTS)
    which, much, begins = m.joined([quality.inputs("some words, and some more!"), quality.inputs("")])
    got = m.raw(which, much, begins)[0]
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(which)], strict=True)):
        i, x = which[a:b], much[a:b]
        pairs = sum(m.v[i[p]] @ m.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert got[k] == pytest.approx(m.w0 + m.w[i] @ x + pairs)


def test_without_labels(spark, tables):
    docs = tables[0]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == 604
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0
