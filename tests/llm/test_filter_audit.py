import random
from collections import Counter
from itertools import permutations

from pyspark.sql import Row

from chronomotif.llm import filter_audit as audit


def fails(doc_id, text, least):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
        out.add("C")
    if any(c in "#$%&*|" for c in text):
        out.add("D")
    if doc_id is not None and least[text] is not None and doc_id > least[text]:
        out.add("E")
    return out


def brute(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        text = text or ""
        least[text] = min((x for x in (least.get(text), doc_id) if x is not None), default=None)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = [(part or "", fails(d, text or "", least), d) for d, text, part in rows]
    out = {}
    for part in {p for p, _, _ in docs}:
        own = [(f, d) for p, f, d in docs if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(f, d) for f, d in left if x in f]
                left = [(f, d) for f, d in left if x not in f]
                shapley[x] += len(gone)
                redundant = sum(x in f for f, _ in own) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(f == {x} for f, _ in own), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone))
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step] += (shapley[x],)
    return out


def random_text(rnd):
    n = rnd.choice([0, 1, 50, 199, 200, 260])
    words = [rnd.choice(["same", "other"]) if rnd.random() < 0.5 else f"w{rnd.randint(0, 10**6)}" for _ in range(n)] if rnd.random() < 0.6 else [f"w{k}" for k in range(n)]
    text = rnd.choice([" ", "\n", "\t\x0b "]).join(words)
    return text + rnd.choice(["", "", " #", " ABCDEFGHIJK" * 9, " é É"])


def test_against_plain_filtering(spark):
    """All orders and steps; nulls in every column, repeated rows and ids, ties of text, columns with the names of the work."""
    rnd = random.Random(9)
    pool = [random_text(rnd) for _ in range(25)] + [None, ""]
    rows = [(rnd.choice([k, k, k, None, 3]), rnd.choice(pool), rnd.choice(["a", "b", "", None])) for k in range(120)]
    rows += [(5, pool[0], "a")] * 3 + [(500, "long " * 40_000, "b")]
    labels = [(rnd.randint(0, 120), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    docs = spark.createDataFrame([Row(doc_id=a, text=b, source=c, part="x", digest=1, good=2, A=3) for a, b, c in rows], "doc_id long, text string, source string, part string, digest int, good int, A int")
    got = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 3 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "few words", None)], docs.schema)
    rows = audit.audit_filters(one, labels).collect()
    assert len(rows) == 600 and {r["shapley"] for r in rows} == {0, 120}


def test_other_filters_and_weights(spark):
    """The audit itself takes any flags: three filters, one weight."""
    flags = spark.createDataFrame([("p", 1, 1, 0, 2), ("p", 0, 1, 0, 3), ("p", 0, 0, 0, 4)], "part string, x int, y int, z int, size int")
    joint = audit.joint_failures(flags, "xyz", ("size",)).first()
    assert joint["joint"] == [3, 1, 2, 1, 0, 0, 0, 0] and joint["joint_size"] == [9, 2, 5, 2, 0, 0, 0, 0]
