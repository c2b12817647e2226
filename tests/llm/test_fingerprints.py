import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronomotif.llm import fingerprints as fp

BLANK, WORD = r"[^\S\n]{0,1024}+", r"\S{1,1024}+"


def pieces(text):
    """Pieces by plain loops: words of at most 1024 characters, two by two at the beginning, then by lines and sentences."""
    out, at = [], 0
    head = re.match(rf"(?:\s{{0,1024}}+{WORD}){{0,16}}+", text).group()
    while at < len(head):
        m = re.compile(rf"(?:\s{{0,1024}}+{WORD}){{1,2}}+").match(head, at)
        out.append(m.group())
        at = m.end()
    while at < len(text):
        n, begin = 0, at
        while n < 16:
            m = re.compile(BLANK + WORD).match(text, at)
            if not m:
                break
            at, n = m.end(), n + 1
            if m.group()[-1] in ".!?":
                break
        at = re.compile(BLANK + r"\n?+").match(text, at).end()
        out.append(text[begin:at])
    return out


def near(a, b):
    x, y = set(pieces(a)), set(pieces(b))
    both = sum(map(len, x)) + sum(map(len, y))
    return 1 - sum(map(len, x ^ y)) / both if both else 1.0


def test_peeling_recovers_the_difference(spark):
    shapes = [(0, 0, 0), (1, 0, 0), (3, 2, 1), (50, 20, 10), (200, 0, 300), (0, 0, 700), (400, 1, 0), (5_000, 9_000, 20_000)]
    rows = [(k, list(range(n)) + list(range(100_000, 100_000 + a)), list(range(n)) + list(range(200_000, 200_000 + b))) for k, (n, a, b) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "id int, a array<bigint>, b array<bigint>")
    # Digests with a length of one: what is found is the size of the difference.
    digest = lambda c: F.transform(c, lambda k: F.xxhash64(k).bitwiseAND(F.lit(~0xFFFF)) + 1)
    out = fp.compare_texts(df.withColumn("a_length", F.lit("taken")), ["id"], ["a_length"], {"a": digest("a"), "b": digest("b")}, [("a", "b")])
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(shapes)
    for k, (n, a, b) in enumerate(shapes):
        assert got[k]["near_a_b"] == pytest.approx(1 - (a + b) / (2 * n + a + b) if n + a + b else 1.0)
        assert (got[k]["a_fingerprint"] == got[k]["b_fingerprint"]) == (a + b == 0)


def test_both_sides_digests_come_back(spark):
    """Digests of both sides against set difference: few and many, nulls, repeats, equal sides, and a text with its edited version."""
    rnd = random.Random(6)
    draw = lambda n: [rnd.getrandbits(63) - 2**62 for _ in range(n)]
    shared, rows = draw(300), []
    for k, (n, a, b) in enumerate([(0, 0, 0), (300, 0, 0), (300, 1, 0), (20, 3, 4), (100, 30, 20), (0, 900, 0), (300, 2000, 1500)]):
        rows.append((k, shared[:n] + draw(a), shared[:n] + draw(b)))
    rows += [(90, None, shared[:5]), (91, shared[:4] * 3, shared[2:6])] + [(100 + k, draw(2), draw(1)) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, x array<bigint>, y array<bigint>")
    got = {r["id"]: (r["only_a"], r["only_b"]) for r in fp.differing_digests(df, ["id"], "x", "y").collect()}
    assert got == {k: (sorted({*(x or [])} - {*(y or [])}), sorted({*(y or [])} - {*(x or [])})) for k, x, y in rows}
    text = " ".join(f"w{k}" for k in range(200))
    one = spark.createDataFrame([(1, text, text.replace("w150", "other"))], "id int, t string, u string")
    pair = fp.differing_digests(one.select("id", fp.digests(F.col("t")).alias("t"), fp.digests(F.col("u")).alias("u")), ["id"], "t", "u").first()
    assert len(pair["only_a"]) == len(pair["only_b"]) == 1
    assert pair["only_a"][0] & 0xFFFF == sum(len(p) for p in set(pieces(text)) - set(pieces(text.replace("w150", "other"))))


def test_no_end_of_attempts_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(fp, "MOST_ATTEMPTS", 1)
    df = spark.createDataFrame([(1, list(range(1000)), [])], "id int, x array<bigint>, y array<bigint>")
    with pytest.raises(RuntimeError, match="don't peel"):
        fp.differing_digests(df, ["id"], "x", "y")


def test_fingerprints_peel_by_themselves(spark):
    """Few differing digests: the subtracted tables of the fingerprints are enough, no digest is looked at again."""
    rows = [(k, list(range(60)), list(range(k, 60 + k))) for k in range(4)]
    df = spark.createDataFrame(rows, "id int, a array<bigint>, b array<bigint>")
    df = df.select("id", *(F.transform(c, lambda k: F.xxhash64(k).bitwiseAND(F.lit(~0xFFFF)) + 1).alias(c) for c in ("a", "b")))
    tables = fp.with_tables(df, ["id"], {"a": "x", "b": "y"}).select("id", "x", "y", F.expr(f"array(struct(cast(array() as {fp.DIGESTS}) as a, cast(array() as {fp.DIGESTS}) as b, cast(null as bigint) as found))").cast(fp.PAIRS).alias("pairs"))
    got = {r["id"]: r["pairs"][0]["found"] for r in fp.subtract_tables(tables, ["id"], [("x", "y")]).collect()}
    assert got == {k: 2 * k for k in range(4)}


def test_stuck_tables_are_retried(spark):
    """So many pairs that some get stuck at first: all are settled, and right, in the end."""
    rows = [(k, [3 * k, 3 * k + 1], [3 * k + 2]) for k in range(4_000)]
    df = spark.createDataFrame(rows, "id int, a array<bigint>, b array<bigint>")
    digest = lambda c: F.transform(c, lambda k: F.xxhash64(k).bitwiseAND(F.lit(~0xFFFF)) + 1)
    pairs = df.select("id", F.array(F.struct(digest("a").alias("a"), digest("b").alias("b"), F.lit(None).cast("bigint").alias("found"))).cast(fp.PAIRS).alias("pairs"))
    first = fp.retry_larger(pairs, ["id"], 1)
    assert 0 < first.filter("pairs[0].found is null").count() < 4_000
    assert fp.settle(pairs, ["id"]).filter("pairs[0].found = 3").count() == 4_000


TEXTS = [
    "alpha beta gamma delta. " * 20, "one two three\n" * 3 + "more words here " * 30, "", "short", "漢字 " * 50, None, " ", "\n\n\n", " lead",
    "x" * 200_000, "x" * 190_000 + " tail", "y" * 3_000 + "\n" + " " * 5_000 + "end", " ".join(f"w{k}" for k in range(900)),
]


def test_query_is_right_for_all_texts(spark, tmp_path):
    rnd = random.Random(2)
    texts = TEXTS + [" ".join(rnd.choice(["on", "the", "ends.", "here\n", "why?"]) for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    rows = [(10 * k + 3, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in fp.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_next"] == pytest.approx(near(t, nxt)) and got[i]["near_edited"] == pytest.approx(near(t, edited))
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (set(pieces(edited)) == set(pieces(t)))


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "z y"), (None, "x y z w"), (None, None), (2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("row", F.lit("taken"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = fp.op10_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 2
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert fp.op10_fingerprints(spark, str(tmp_path / "none")).count() == 0


def test_a_changed_word_spoils_one_piece(spark):
    """A word put in changes the pieces up to the end of its sentence, and no later ones."""
    words = [f"w{k:03d}" + "." * (k % 10 == 9) for k in range(320)]
    rows = [(1, " ".join(words), " ".join([*words[:103], "more", *words[103:]]))]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    out = fp.compare_texts(df, ["id"], [], {"t": fp.digests(F.col("t")), "u": fp.digests(F.col("u"))}, [("t", "u")])
    assert out.first()["near_t_u"] == pytest.approx(near(rows[0][1], rows[0][2])) and near(rows[0][1], rows[0][2]) > 0.95
