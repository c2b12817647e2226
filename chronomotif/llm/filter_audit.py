"""Filter interaction audit by inclusion and exclusion (operator 12).

For every set of filters one number is aggregated: how many documents fail all
of them, the sum of the product of their flags. Everything else follows from
these 32 numbers without reading documents again. A Möbius inversion gives how
many documents survive any set of filters, and so what each filter removes at
any place of any order, what was gone before it, and what it alone catches. The
documents that a set of filters removes are a game whose dividends are, but for
a sign, those same joint counts, so a filter's Shapley value is a sum of them,
each shared by the filters of its set.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import bound, materialize, table, text_or_empty

FILTERS = "ABCDE"
SEPARATOR = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
#: Tasks over which rows without an id are spread where rows are joined by id.
SPREAD = 1024


def text_flags(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of them distinct), C (over 2 % capitals), D (has marks)."""
    words = F.filter(F.split(text, SEPARATOR), lambda w: w != "")
    counts = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [counts["n"] < 200, 100 * counts["distinct"] < 50 * counts["n"], 100 * capitals > 2 * F.char_length(text), text.rlike(MARKS)]


def flagged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part``, the flags ``A`` to ``E`` as 0 or 1, and ``good, toxic`` for each row of ``df``.

    Texts are read once and left behind with a digest. The first of equal texts
    is found by digest, which sums before it shuffles, and its rows by digest
    and id together, so that no group of copies meets in one task.
    """
    text = text_or_empty(F.col(text_col).cast("string"))
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.crc32("text"), F.lit(SPREAD))).otherwise(0).cast("int")
    flags = [f.cast("int").alias(name) for name, f in zip(FILTERS, text_flags(F.col("text")), strict=False)]
    small = materialize(base.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), spread.alias("spread"), *flags), "flags")
    first = small.groupBy("digest").agg(F.min("doc_id").alias("first_id")).filter("first_id is not null")
    first = first.select(F.col("digest").alias("of_digest"), "first_id")
    is_first = (F.col("digest") == F.col("of_digest")) & (F.col("doc_id") == F.col("first_id"))
    known = labels.select(F.col("doc_id").alias("of_id"), "quality", "toxic").filter("of_id is not null")
    known = known.groupBy("of_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.withColumn("of_spread", F.lit(0))
    rows = small.join(first, is_first, "left").withColumn("E", (F.col("doc_id").isNotNull() & F.col("first_id").isNull()).cast("int"))
    rows = rows.join(known, (F.col("doc_id") == F.col("of_id")) & (F.col("spread") == F.col("of_spread")), "left")
    return rows.select("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def joint_failures(rows: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """By ``part``: ``joint``, and ``joint_<weight>``, arrays over all sets of filters of how much fails each filter of the set.

    The set's place in the array has a bit for each filter, the first the lowest.
    """
    sums = []
    for name in ("", *weights):
        each = []
        for mask in range(1 << len(filters)):
            product = F.col(name).cast("long") if name else F.lit(1).cast("long")
            for i, f in enumerate(filters):
                if mask >> i & 1:
                    product = product * F.col(f)
            each.append(F.sum(product))
        sums.append(F.array(*each).alias(f"joint_{name}" if name else "joint"))
    return rows.groupBy("part").agg(*sums)


def _sign(mask: int) -> int:
    return -1 if mask.bit_count() % 2 else 1


def survivors(joint: Column, n: int) -> Column:
    """For every set of ``n`` filters, how much fails none of it: the joint failures of its subsets, with alternating signs."""
    return F.array(*(sum((_sign(sub) * F.get(joint, F.lit(sub)) for sub in range(mask + 1) if sub & ~mask == 0), F.lit(0).cast("long")) for mask in range(1 << n)))


def unique_failures(joint: Column, n: int) -> Column:
    """For every filter, how much fails it and no other."""
    whole = range(1 << n)
    return F.array(*(sum((-_sign(mask) * F.get(joint, F.lit(mask)) for mask in whole if mask >> i & 1), F.lit(0).cast("long")) for i in range(n)))


def shapley_sums(joint: Column, n: int) -> Column:
    """For every filter, its removals summed over all orders: ``n!`` times its shares of the dividends of its sets.

    The dividend of a set is how much fails all of it, negative for sets of an
    even size; each member has an equal share. ``n!`` divided by a set's size is whole.
    """
    whole = range(1 << n)
    return F.array(*(sum((-_sign(mask) * (factorial(n) // mask.bit_count()) * F.get(joint, F.lit(mask)) for mask in whole if mask >> i & 1), F.lit(0).cast("long")) for i in range(n)))


def interactions(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step`` and what the step's filter does there, from the joint failures of each part."""
    n = len(filters)
    orders = F.lit(["".join(p) for p in permutations(filters)])
    rows = joint.select(
        "part",
        "joint",
        survivors(F.col("joint"), n).alias("left"),
        survivors(F.col("joint_good"), n).alias("left_good"),
        survivors(F.col("joint_toxic"), n).alias("left_toxic"),
        unique_failures(F.col("joint"), n).alias("unique"),
        shapley_sums(F.col("joint"), n).alias("shares"),
        F.explode(orders).alias("filter_order"),
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    prior = sum((F.when(F.instr("filter_order", F.lit(f)) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumns({"place": place, "prior": prior}).withColumn("bit", F.get(F.lit([1 << i for i in range(n)]), F.col("place")))
    removed = lambda left: F.get(left, F.col("prior")) - F.get(left, F.col("prior") + F.col("bit"))
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        F.get("left", F.col("prior") + F.col("bit")).alias("kept"),
        removed("left").alias("removed"),
        (F.get("joint", F.col("bit")) - removed("left")).alias("redundant"),
        F.get("unique", F.col("place")).alias("unique_fails"),
        removed("left_good").alias("good_lost"),
        removed("left_toxic").alias("toxic_lost"),
        F.get("shares", F.col("place")).alias("shapley"),
    )


def audit_filters(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step of it.

    A null text is an empty one and fails A; a null part is the empty text; a
    row without an id fails E never, and makes no other fail it; rows that
    repeat an id with its text are rows each, none a copy of the other; labels
    that repeat an id count as 1 if one of them does; an empty table has no
    parts and gives no rows. Other columns are not read.
    """
    return interactions(joint_failures(flagged(df, labels, id_col, text_col, part_col)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same for DuckDB by plain counting: for each order, where a document's first failure lies.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
p AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS x, filter_order[1:step - 1] AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, x,
 sum(CASE WHEN fails = '' OR NOT regexp_matches(fails, '[' || prior || x || ']') THEN n ELSE 0 END) AS kept,
 sum(CASE WHEN contains(fails, x) AND NOT (prior <> '' AND regexp_matches(fails, '[' || CASE prior WHEN '' THEN '_' ELSE prior END || ']')) THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN contains(fails, x) AND prior <> '' AND regexp_matches(fails, '[' || CASE prior WHEN '' THEN '_' ELSE prior END || ']') THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN contains(fails, x) AND NOT (prior <> '' AND regexp_matches(fails, '[' || CASE prior WHEN '' THEN '_' ELSE prior END || ']')) THEN good ELSE 0 END) AS good_lost,
 sum(CASE WHEN contains(fails, x) AND NOT (prior <> '' AND regexp_matches(fails, '[' || CASE prior WHEN '' THEN '_' ELSE prior END || ']')) THEN toxic ELSE 0 END) AS toxic_lost
 FROM g, p GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""
