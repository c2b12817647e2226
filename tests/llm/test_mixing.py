import pytest

from chronomotif.llm import mixing


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_w = sum(weight[s] for s in names if s not in full)
        t = {s: 3 * sizes[s] if s in full else left * weight[s] / open_w for s in names}
        over = {s for s in names if t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mix(spark):
    rows = [(k, " ".join(["w"] * (k % 17 + 1)), "abc"[k % 3] if k % 5 else "a") for k in range(400)]
    rows += [(1000, "x y", None), (1001, None, "d"), (1002, "", "d"), (None, "q r s", "b"), (2007, "one two", "é"), (2007, "one two", "é"), (2008, "tiny", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "size")
    out = mixing.mix_sources(df, source_col="size").collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = expected_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    by_id = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in ("a", "b", "c"):
        assert abs(taken[s] - want[s]) <= 17
    again = mixing.mix_sources(df.repartition(3), source_col="size").collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_rows_of_the_mixture(spark):
    df = spark.createDataFrame([(k, "w " * 10, "a" if k < 30 else "b", k) for k in range(40)], "doc_id long, text string, source string, h int")
    times = {r["doc_id"]: r["times"] for r in mixing.mix_sources(df).collect()}
    rows = mixing.mixture(df)
    assert rows.columns == df.columns
    got = {}
    for r in rows.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in times.items() if n}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_sources(blank).collect()] == [0, 0]
