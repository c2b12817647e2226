import random

import pytest

from chronomotif.llm import common, ngram_join


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute(texts):
    sets = sets_of(texts)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    line = [rnd.choice(words) for _ in range(20)]
    texts = []
    for k in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 5, 9, 40, 80]))]
        for _ in range(rnd.choice([1, 1, 2, 8])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            if rnd.random() < 0.4:
                t = line + t
            texts.append((len(texts) * 3 + 1, " ".join(t) if rnd.random() < 0.9 else "\n".join(t).upper()))
    return texts + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "É x"), (1006, "é x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "SAMPLE_COMMON", 8)
    monkeypatch.setattr(ngram_join, "LEADER_GROWTH", 2)
    monkeypatch.setattr(ngram_join, "FLUSH_TOKENS", 500)
    texts = corpus(seed)
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("text", "body")
    out = ngram_join.ngram_components(df, text_col="body").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(texts)
    assert len(out) == len(texts)


def test_odd_rows(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert out == [(1, 2, 1), (2, 2, 1), (None, None, None)]
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_every_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEADER_GROWTH", 2)
    monkeypatch.setattr(ngram_join, "MEETING_ROWS", 3)
    texts = corpus(3)
    members, links = ngram_join.ngram_links(spark.createDataFrame(texts, "doc_id long, text string"))
    sets = sets_of(texts)
    named = {i: s for i, s in sets.items() if s}
    want = {i: min(j for j, t in named.items() if t == s) for i, s in named.items()}
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == want
    reps = sorted(set(want.values()))
    pairs = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 5


def test_large_groups_are_split(spark, monkeypatch):
    """Exact and near copies of one text, more than a task is given: the same components."""
    monkeypatch.setattr(ngram_join, "MEETING_ROWS", 4)
    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    base = [f"w{k}" for k in range(60)]
    near = [(k, " ".join([*base[:50], f"x{k}", f"y{k}"])) for k in range(60)]
    texts = near + [(100 + k, " ".join(base)) for k in range(60)] + [(200 + k, f"other text of its own with number {k} at the end") for k in range(60)]
    out = ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(texts)


def test_repeated_ids_with_other_texts(spark):
    texts = [(1, "b b c d e f g"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "b b c d e f g")]
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
