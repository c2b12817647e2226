"""Mixing sources to target weights by hash-threshold histograms (operator 4).

Every document has a hash. A source takes each of its documents a whole number
of times, and those whose hash lies below a threshold once more. The threshold
comes from a histogram of sizes by source and leading hash bits: the bucket in
which the budget runs out is refined by the next bits, again and again, until
one hash value is left. Documents are filtered, never sorted, and a larger
budget always takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomotif.llm.common import materialize, table

#: Hash bits that a level of the histogram resolves, and bits of a hash.
LEVEL_BITS = 10
HASH_BITS = 63
#: Times that a document can be taken at most.
MOST = 3
#: Sources up to which their table is sent to every task.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size`` to these and ``target``.

    Weights 1, 2, 3 repeat along the sources by code point, null last. A target
    stops at ``most`` times its source's size. Sources fill up in the order of
    that bound per weight: one is full if the level of those that are not yet
    full, once all before it are, exceeds its bound.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fills = Window.orderBy("bound", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size").cast("double")
    out = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("bound", cap / F.col("weight"))
    total = F.sum("source_size").over(everything).cast("double")
    weights = F.sum("weight").over(everything)
    level = (total - F.coalesce(F.sum(cap).over(fills), F.lit(0.0))) / (weights - F.coalesce(F.sum("weight").over(fills), F.lit(0)))
    out = out.withColumn("total", total).withColumn("full", F.col("bound") < level)
    left = F.col("total") - F.sum(F.when(F.col("full"), cap).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    share = left * F.col("weight") / F.when(open_weight > 0, open_weight)
    return out.withColumn("target", F.when(F.col("full"), cap).otherwise(F.least(share, cap))).select("source", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """By source: ``times`` that all is taken, and the hash ``cut`` below which, or ``tie`` at which, once more.

    ``sized`` has ``source, size, h``; it is read once for each level, by the
    boundary bucket of each source alone after the first.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("times", F.least(times, F.lit(MOST)).cast("int"))
    state = goals.withColumn("need", F.greatest(F.col("target") - F.col("times") * F.col("source_size"), F.lit(0.0)))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("sum", F.lit(0).cast("long"))
    state = state.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(2**HASH_BITS - 1).cast("long"))
    state = materialize(state, "mix-goals")
    small = state.count() <= BROADCAST_SOURCES
    done = 0
    while done < HASH_BITS:
        before, done = HASH_BITS - done, min(HASH_BITS, done + LEVEL_BITS)
        if not state.filter("low < high").limit(1).count():
            break
        bounds = state.filter("low < high").select(F.col("source").alias("of"), "prefix", "need")
        inside = sized.join(
            F.broadcast(bounds) if small else bounds,
            F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", before) == F.col("prefix")),
        )
        buckets = inside.groupBy("of", F.shiftright("h", HASH_BITS - done).alias("key")).agg(
            F.sum("size").alias("in_bucket"), F.min("h").alias("first"), F.max("h").alias("last"), F.max("need").alias("rest")
        )
        upto = F.sum("in_bucket").over(Window.partitionBy("of").orderBy("key"))
        found = buckets.withColumn("upto", upto).filter((F.col("upto") - F.col("in_bucket") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        found = found.select("of", "key", "in_bucket", "first", "last", (F.col("rest") - F.col("upto") + F.col("in_bucket")).alias("over"))
        joined = state.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        was_open = F.col("low") < F.col("high")
        none = was_open & F.col("key").isNull()  # nothing to divide: all or nothing is below
        state = materialize(
            joined.select(
                "source",
                "source_size",
                "target",
                "times",
                F.when(F.col("key").isNotNull(), F.col("over")).otherwise(F.col("need")).alias("need"),
                F.coalesce("key", "prefix").alias("prefix"),
                F.when(none, 0).otherwise(F.coalesce("in_bucket", "sum")).cast("long").alias("sum"),
                F.when(none, 2**HASH_BITS - 1).otherwise(F.coalesce("first", "low")).alias("low"),
                F.when(none, 2**HASH_BITS - 1).otherwise(F.coalesce("last", "high")).alias("high"),
            ),
            "mix-level",
        )
    tie = (F.col("sum") > 0) & (2 * F.col("need") >= F.col("sum"))
    return state.select("source", "source_size", "target", "times", F.col("low").alias("cut"), tie.alias("tie"))


def _hash(id_col: str, text_col: str) -> Column:
    """63 bits of MD5 over id and text: a hash that other engines have too."""
    digest = F.md5(F.concat_ws("#", F.col(id_col).cast("string"), F.col(text_col)))
    return F.shiftrightunsigned(F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), 1)


def _with_times(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (``source, h``) with ``times``, by the table of cuts, which is sent to every task if it is small."""
    cuts = cuts.withColumnRenamed("source", "of")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    once_more = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("tie"))
    times = F.least(F.col("times") + F.when(once_more, 1).otherwise(0), F.lit(MOST))
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", times)


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    small = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _hash(id_col, text_col).alias("h"))
    return materialize(small, "mix-sizes")


def source_cuts(sized: DataFrame) -> DataFrame:
    return thresholds(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, times`` for every row of ``df``.

    ``times`` says how often the mix takes the row: ``taken`` is that many
    times its size in words. A null text has no words and is never taken
    beyond its source's whole rounds; null sources are one source, the last;
    null ids and repeated rows have a row each, equal rows being taken alike;
    an empty table gives an empty result. Other columns are not read.
    """
    sized = _sizes(df, id_col, text_col, source_col)
    mixed = _with_times(sized, source_cuts(sized))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, with its columns."""
    cuts = source_cuts(_sizes(df, id_col, text_col, source_col)).select("source", "times", "cut", "tie")
    rows = df.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), _hash(id_col, text_col).alias("h"))
    taken = _with_times(rows, cuts).filter("times > 0").withColumn("round", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("times").withColumn("target", F.round("target", 6))


#: The same mix for DuckDB: targets by the same filling up, thresholds by running sums over all hashes.
SQL = """WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
 CAST(('0x' || substr(md5(concat_ws('#', CAST(doc_id AS VARCHAR), text)), 1, 16))::UHUGEINT // 2 AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
b AS (SELECT *, 3.0 * source_size AS cap, sum(3.0 * source_size) OVER o AS caps, sum(weight) OVER o AS ws, sum(weight) OVER () AS weights FROM w
 WINDOW o AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / weight < (total - coalesce(caps, 0)) / (weights - coalesce(ws, 0)) AS filled FROM b),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(cap, (total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()) * weight
 / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ()) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS times FROM t),
r AS (SELECT d.*, g.source_size, g.target, g.times, g.target - g.times * g.source_size AS need,
 sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * least(3, times + CASE WHEN upto <= need OR (upto - tied <= need AND 2 * (need - upto + tied) >= tied) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
