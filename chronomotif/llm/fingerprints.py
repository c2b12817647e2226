"""Document fingerprints as invertible Bloom lookup tables (operator 10).

A text is cut into pieces of its paragraphs; each has a digest that carries the
piece's length. A table cell holds the count of the digests hashed to it, their
xor, and the xor of their check sums; every digest goes to one cell in each of
three parts of the table. Tables of two versions are subtracted cell by cell,
and peeling takes out the digests that stand alone in a cell: what is recovered
is what the versions don't share. Where peeling gets stuck, both versions are
put into a larger table, under other hashes, and so on until it empties.

Digests, cells and peeling rounds are rows: they are grouped by document and
cell, where documents already lie, so that only texts and digests are shuffled.
All of it is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomotif.llm.common import materialize, shuffle_partitions, table, text_or_empty

#: The first words are cut finely, so that short texts have pieces too: words in all, words a piece.
HEAD_WORDS, HEAD_PIECE = 16, 2
#: Most words of a piece of a line; it ends with a sentence before that.
PIECE = 16
#: Longer words, and longer blanks between them, are cut: a piece has fewer than 65536 characters.
WORD_CHARS = 1024
#: Parts of a table, slots of each in the fingerprint, and digests for which a larger table has three slots, two at the least.
PARTS, BASE_SLOTS = 3, 8
DIGESTS_PER_SLOT = 1.5
#: Peeling steps before a table counts as stuck, each for one part: of the fingerprint, of larger tables.
BASE_STEPS, STEPS = 6, 9
#: Larger and larger tables that are tried before it counts as an error: each doubles the slots, and gets stuck once in many.
MOST_ATTEMPTS = 16

CELLS = "array<struct<cell:bigint,n:bigint,key:bigint,check:bigint>>"
STORED = "array<struct<cell:tinyint,n:int,key:bigint,check:int>>"
DIGESTS = "array<bigint>"
PAIRS = f"array<struct<a:{DIGESTS},b:{DIGESTS},found:bigint>>"
_BLANK, _WORD = rf"[^\S\n]{{0,{WORD_CHARS}}}+", rf"\S{{1,{WORD_CHARS}}}+"
HEAD = rf"^(?:\s{{0,{WORD_CHARS}}}+{_WORD}){{0,{HEAD_WORDS}}}+"
HEAD_PIECES = rf"(?:\s{{0,{WORD_CHARS}}}+{_WORD}){{1,{HEAD_PIECE}}}+"
LINE_PIECES = rf"(?=[\s\S])(?:{_BLANK}{_WORD}(?<![.!?])){{0,{PIECE - 1}}}+(?:{_BLANK}{_WORD})?+{_BLANK}\n?+"


def digests(text: Column) -> Column:
    """Distinct digests of a text's pieces: 48 bits of hash, 16 of length."""
    head = F.regexp_extract(text, HEAD, 0)
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    pieces = F.concat(F.regexp_extract_all(head, F.lit(HEAD_PIECES), F.lit(0)), F.regexp_extract_all(rest, F.lit(LINE_PIECES), F.lit(0)))
    key = lambda p: F.xxhash64(p).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(F.char_length(p).cast("long"))
    return F.array_distinct(F.transform(pieces, key))


def length(keys: Column) -> Column:
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + k.bitwiseAND(F.lit(0xFFFF)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def _place(key: Column, slots: Column, part: int, attempt: int) -> Column:
    """The cell of a digest in a part of a table; every attempt has hashes of its own."""
    return F.xxhash64(key, F.lit(PARTS * attempt + part)).bitwiseAND(slots - 1) * PARTS + part


def _spread(df: DataFrame, by: list[str], entries: Column, fields: list[str]) -> DataFrame:
    """A row for each entry of each row of ``df``, and one, with null fields, that carries the row itself."""
    row = F.struct(*(c for c in df.columns if c not in by))
    none = F.lit(None).cast(df.select(row.alias("row")).schema["row"].dataType)
    carrier = F.struct(row.alias("row"), *(F.lit(None).cast("bigint").alias(f) for f in fields))
    each = lambda x: F.struct(none.alias("row"), *(x[f].cast("bigint").alias(f) for f in fields))
    return df.select(*by, F.inline(F.concat(F.array(carrier), F.transform(entries, each))))


def _sums(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells by key, without those that are empty; rows that carry a row stay."""
    out = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return out.filter("row is not null or cell = -1 or n <> 0 or key <> 0 or check <> 0")


def _returned(rows: DataFrame, by: list[str], df: DataFrame, what: Column) -> DataFrame:
    """Rows as they were carried, with an array ``got`` of what the others hold."""
    out = rows.groupBy(*by).agg(F.collect_list(F.struct("row", what.alias("x"))).alias("all"))
    row = F.get(F.filter("all", lambda r: r["row"].isNotNull()), F.lit(0))["row"]
    got = F.transform(F.filter("all", lambda r: r["row"].isNull()), lambda r: r["x"])
    out = out.select(*by, row.alias("row"), got.alias("got"))
    return out.select(*by, *(F.col("row")[c].alias(c) for c in df.columns if c not in by), "got")


def with_tables(df: DataFrame, by: list[str], sides: dict[str, str]) -> DataFrame:
    """``df`` with the table of each array of digests (``sides``: their columns to those of the tables): cells that aren't empty, in order.

    ``by`` tells rows apart. Rows are grouped by it; where ``df`` lies by its
    first column they aren't shuffled.
    """
    names = list(sides)
    of = lambda c, s: F.transform(c, lambda k: F.struct(F.lit(s).alias("side"), k.alias("key")))
    entries = F.flatten(F.array(*(of(c, s) for s, c in enumerate(names))))
    rows = _spread(df, by, entries, ["side", "key"])
    rows = rows.withColumn("part", F.explode(F.when(F.col("key").isNull(), F.array(F.lit(0))).otherwise(F.array(*(F.lit(p) for p in range(PARTS))))))
    slots = F.lit(BASE_SLOTS)
    cell = F.when(F.col("part") == 0, _place(F.col("key"), slots, 0, 0)).when(F.col("part") == 1, _place(F.col("key"), slots, 1, 0)).otherwise(_place(F.col("key"), slots, 2, 0))
    rows = rows.select(*by, "row", "side", cell.alias("cell"), F.lit(1).cast("long").alias("n"), "key", _check(F.col("key")).alias("check"))
    rows = _sums(rows, [*by, "row", "side", "cell"])
    out = _returned(rows, by, df, F.struct("side", F.struct("cell", "n", "key", "check").alias("cell")))
    cells = lambda s: F.array_sort(F.transform(F.filter("got", lambda x: x["side"] == s), lambda x: x["cell"]))
    return out.select(*(c for c in out.columns if c not in ("got", *sides.values())), *(cells(s).alias(sides[c]) for s, c in enumerate(names)))


def _peeled(df: DataFrame, by: list[str], cells: DataFrame, attempt: int, steps: int) -> DataFrame:
    """``df`` with ``got``: by ``pair``, the length of the digests recovered (``found``) and the cells that are ``left``.

    Each step takes out of one part of the tables every digest that is alone
    in its cell: no digest twice, as it has one cell there.
    """
    keys = [*by, "row", "pair", "slots", "cell"]
    cells = _sums(cells, keys)
    for step in range(steps):
        part = step % PARTS
        alone = (F.col("cell") % PARTS == part) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
        zero = F.lit(0).cast("long")
        found = F.struct(F.lit(-1).cast("long").alias("cell"), F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("n"), zero.alias("key"), zero.alias("check"))
        out = [F.struct(_place(F.col("key"), F.col("slots"), p, attempt).alias("cell"), (-F.col("n")).alias("n"), "key", "check") for p in range(PARTS) if p != part]
        cells = cells.select(*keys[:-1], F.inline(F.when(alone, F.array(found, *out)).otherwise(F.array(F.struct("cell", "n", "key", "check")))))
        cells = _sums(cells, keys)
    pairs = cells.groupBy(*by, "row", "pair").agg(F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)).alias("found"), F.count_if(F.col("cell") >= 0).alias("left"))
    return _returned(pairs, by, df, F.struct("pair", "found", "left"))


def _settled(df: DataFrame) -> DataFrame:
    """``pairs`` with what ``got`` tells; those that are settled drop their digests."""

    def one(p: Column, i: Column) -> Column:
        mine = F.get(F.filter("got", lambda g: g["pair"] == i), F.lit(0))
        found = F.when(p["found"].isNotNull(), p["found"]).when(mine.isNull(), 0).when(mine["left"] == 0, mine["found"])
        none = F.array().cast(DIGESTS)
        return F.struct(F.when(found.isNull(), p["a"]).otherwise(none).alias("a"), F.when(found.isNull(), p["b"]).otherwise(none).alias("b"), found.alias("found"))

    return df.withColumn("pairs", F.transform("pairs", one)).drop("got")


def subtract_tables(df: DataFrame, by: list[str], tables: list[tuple[str, str]]) -> DataFrame:
    """``df`` with ``pairs`` (see :data:`PAIRS`) settled where two fingerprints' tables, subtracted, peel.

    ``tables`` names the columns of the two tables of each pair.
    """

    def signed(c: str, i: int, by_: int) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(i).alias("pair"), F.lit(BASE_SLOTS).alias("slots"), x["cell"], (x["n"] * by_).alias("n"), x["key"], x["check"]))

    entries = F.flatten(F.array(*(signed(c, i, s) for i, both in enumerate(tables) for c, s in zip(both, (1, -1), strict=True))))
    cells = _spread(df, by, entries, ["pair", "slots", "cell", "n", "key", "check"])
    return _settled(_peeled(df, by, cells, 0, BASE_STEPS))


def retry_larger(df: DataFrame, by: list[str], attempt: int) -> DataFrame:
    """``df`` with those of its ``pairs`` that aren't settled tried in larger tables, of twice the slots from attempt to attempt."""

    def both(p: Column, i: Column) -> Column:
        wanted = F.greatest((F.size(p["a"]) + F.size(p["b"])) / F.lit(DIGESTS_PER_SLOT), F.lit(2.0))
        slots = F.call_function("shiftleft", F.lit(1).cast("long"), (F.ceil(F.log2(wanted)) + (attempt - 1)).cast("int"))
        side = lambda c, sign: F.transform(p[c], lambda k: F.struct(i.alias("pair"), slots.alias("slots"), F.lit(sign).alias("n"), k.alias("key")))
        return F.when(p["found"].isNull(), F.concat(side("a", 1), side("b", -1))).otherwise(F.array().cast("array<struct<pair:int,slots:bigint,n:int,key:bigint>>"))

    rows = _spread(df, by, F.flatten(F.transform("pairs", both)), ["pair", "slots", "n", "key"])
    at = F.array(*(_place(F.col("key"), F.col("slots"), p, attempt) for p in range(PARTS)))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("key").isNull(), F.array(F.lit(None).cast("long"))).otherwise(at)))
    return _settled(_peeled(df, by, rows.withColumn("check", _check(F.col("key"))), attempt, STEPS))


def settle(df: DataFrame, by: list[str], attempt: int = 1) -> DataFrame:
    """``df`` with all its ``pairs`` settled: the first attempt where rows lie, then only those that are left, from written tables."""
    rows, done, last = materialize(retry_larger(df, by, attempt), "sketches"), [], attempt + MOST_ATTEMPTS
    left = F.exists("pairs", lambda p: p["found"].isNull())
    while rows.filter(left).limit(1).count():
        attempt += 1
        if attempt > last:
            raise RuntimeError(f"tables don't peel after {MOST_ATTEMPTS} attempts, each larger than the one before")
        done.append(rows.filter(~left))
        rows = materialize(retry_larger(rows.filter(left), by, attempt), "sketches")
    for d in done:
        rows = rows.unionByName(d)
    return rows


def differing_digests(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """``by``, ``only_a`` and ``only_b``: the digests of either side (arrays ``a`` and ``b``) that the other lacks, as peeling recovers them.

    The first table is as large as the fingerprint's; where it gets stuck, both
    sides go into one that is sized by their digests, then into larger ones.
    Rows are told apart by ``by``; a null array is an empty one, and digests
    that a side repeats count once. What is recovered carries the sign of its side.
    """
    once = lambda c: F.coalesce(F.array_distinct(F.col(c).cast(DIGESTS)), F.array().cast(DIGESTS))
    rest, done = materialize(df.select(*by, once(a).alias("_a"), once(b).alias("_b")), "sides"), []
    none = F.lit(None).cast("long")
    for attempt in range(MOST_ATTEMPTS):
        wanted = F.ceil(F.log2(F.greatest((F.size("_a") + F.size("_b")) / F.lit(DIGESTS_PER_SLOT), F.lit(2.0)))).cast("int")
        slots = F.lit(BASE_SLOTS).cast("long") if not attempt else F.call_function("shiftleft", F.lit(1).cast("long"), wanted + (attempt - 1))
        side = lambda c, sign: F.transform(c, lambda k: F.struct(F.lit(sign).cast("long").alias("n"), k.alias("key")))
        rows = rest.select(*by, slots.alias("slots"), F.inline(F.concat(side("_a", 1), side("_b", -1))))
        cells = rows.select(*by, "slots", "n", "key", _check(F.col("key")).alias("check"), none.alias("taken"), F.explode(F.array(*(_place(F.col("key"), F.col("slots"), p, attempt) for p in range(PARTS)))).alias("cell"))
        keys = [*by, "slots", "cell", "taken"]
        for step in range(STEPS + 1):
            cells = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")).filter("taken is not null or n <> 0 or key <> 0 or check <> 0")
            if step == STEPS:
                break
            part = step % PARTS
            alone = F.col("taken").isNull() & (F.col("cell") % PARTS == part) & (F.abs("n") == 1) & (F.col("check") == _check(F.col("key")))
            found = F.struct(F.lit(-1).cast("long").alias("cell"), "n", "key", "check", F.col("key").alias("taken"))
            out = [F.struct(_place(F.col("key"), F.col("slots"), p, attempt).alias("cell"), (-F.col("n")).alias("n"), "key", "check", none.alias("taken")) for p in range(PARTS) if p != part]
            stay = F.struct("cell", "n", "key", "check", "taken")
            cells = cells.select(*by, "slots", F.inline(F.when(alone, F.array(found, *out)).otherwise(F.array(stay))))
        of = lambda sign: F.array_sort(F.collect_list(F.when(F.col("n") == sign, F.col("taken"))))
        told = cells.groupBy(*by).agg(of(1).alias("only_a"), of(-1).alias("only_b"), F.count_if(F.col("taken").isNull()).alias("left"))
        nothing = F.array().cast(DIGESTS)
        rows = materialize(rest.join(told, by, "left").withColumns({"only_a": F.coalesce("only_a", nothing), "only_b": F.coalesce("only_b", nothing), "left": F.coalesce("left", F.lit(0))}), "recovered")
        done.append(rows.filter("left = 0").select(*by, "only_a", "only_b"))
        rest = rows.filter("left > 0").select(*by, "_a", "_b")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"tables don't peel after {MOST_ATTEMPTS} attempts, each larger than the one before")


def likeness(found: Column, a_length: Column, b_length: Column) -> Column:
    """Share of the characters, in both texts' distinct pieces, that lie in shared ones: 0 to 1; 1 for two empty texts."""
    both = a_length + b_length
    return F.when(both == 0, 1.0).otherwise(1.0 - found / F.when(both != 0, both))


def stored(cells: Column) -> Column:
    """Cells in fewer bytes: of check sums the high 32 bits, which is what a fingerprint shows."""
    return F.transform(cells, lambda c: F.struct(c["cell"], c["n"], c["key"], F.shiftright(c["check"], 32).alias("check"))).cast(STORED)


def serialized(n: Column, cells: Column) -> Column:
    """Number of digests and the cells of the fingerprint, as text."""
    cell = lambda c: F.concat_ws(".", c["cell"].cast("string"), c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.concat(n.cast("string"), F.lit("|"), F.array_join(F.transform(cells, cell), "|"))


def compare_texts(df: DataFrame, by: list[str], keep: list[str], texts: dict[str, Column], pairs: list[tuple[str, str]], shown: list[str] | None = None) -> DataFrame:
    """``by`` and the columns ``keep``, with ``<name>_fingerprint`` for each of ``texts`` (digests by name; or for those ``shown``), and ``near_<a>_<b>`` for each of ``pairs``.

    Rows are told apart by ``by``, and lie best by its first column. Digests of
    null or empty texts are none; they are like each other and nothing else.
    Repeated rows are rows of their own; an empty table gives an empty result.
    Columns that aren't named in ``keep`` are left out, and so is one that has
    the name of a new one.
    """
    new = {*(f"{n}_{what}" for n in texts for what in ("digests", "cells", "length", "size", "fingerprint")), *(f"near_{a}_{b}" for a, b in pairs), "pairs"}
    kept = [*by, *(c for c in keep if c not in new)]
    rows = df.select(*kept, *(d.alias(f"{n}_digests") for n, d in texts.items()))
    rows = with_tables(rows, by, {f"{n}_digests": f"{n}_cells" for n in texts})
    both = [F.struct(F.col(f"{a}_digests").alias("a"), F.col(f"{b}_digests").alias("b"), F.lit(None).cast("bigint").alias("found")) for a, b in pairs]
    rows = rows.withColumn("pairs", F.array(*both).cast(PAIRS))
    for n in texts:
        rows = rows.withColumn(f"{n}_size", F.size(f"{n}_digests")).withColumn(f"{n}_length", length(F.col(f"{n}_digests"))).drop(f"{n}_digests")
    rows = subtract_tables(rows, by, [(f"{a}_cells", f"{b}_cells") for a, b in pairs])
    shown = list(texts) if shown is None else shown
    # What is written for a fingerprint is its cells, shorter than their text.
    rows = rows.select(*(c for c in rows.columns if not c.endswith("_cells") or c[:-6] not in texts), *(stored(F.col(f"{n}_cells")).alias(f"{n}_cells") for n in shown))
    rows = settle(rows, by)
    near = [likeness(F.col("pairs")[i]["found"], F.col(f"{a}_length"), F.col(f"{b}_length")).alias(f"near_{a}_{b}") for i, (a, b) in enumerate(pairs)]
    return rows.select(*kept, *(serialized(F.col(f"{n}_size"), F.col(f"{n}_cells")).alias(f"{n}_fingerprint") for n in shown), *near)


def neighbours(rows: DataFrame) -> DataFrame:
    """From distinct ``doc_id, n``: ``doc_id, before_id, before_n``, each id's predecessor, the first's being the last.

    Ids are dealt by ranges; within a range a window finds the predecessor, and
    the first of a range takes the last of the range before.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ids")
    inside = Window.partitionBy("part").orderBy("doc_id")
    last = F.max(F.struct("doc_id", "n")).alias("last")
    ends = dealt.groupBy("part").agg(last)
    by_part = Window.orderBy("part")  # a row for each range
    everything = Window.partitionBy()
    ends = ends.select(
        F.col("part").alias("of"),
        F.coalesce(F.lag("last").over(by_part), F.max("last").over(everything)).alias("before"),
    )
    rows = dealt.withColumn("lag", F.lag(F.struct("doc_id", "n")).over(inside)).join(ends, F.col("part") == F.col("of"))
    before = F.coalesce("lag", "before")
    return rows.select("doc_id", before["doc_id"].alias("before_id"), before["n"].alias("before_n"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents and their edited texts. Of rows that repeat an id, the smallest text is the one that others have as their next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    # The key by which texts are dealt, once, for both joins; rows without an id are dealt by their texts, and have no next one.
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("at"), F.col("doc_id").isNull().alias("nameless"), "text")
    ids = docs.filter("not nameless").groupBy(F.col("at").alias("doc_id")).agg(F.max(F.char_length("text")).alias("n"))
    known = neighbours(ids).select(F.col("doc_id").alias("of"), F.col("before_id").alias("before"), "before_n")
    # What the document before needs of a document: its first characters and its digests.
    dealt = docs.join(known.hint("shuffle_hash"), F.col("at") == F.col("of"))
    start = F.left("text", F.floor(F.col("before_n") / 4).cast("int"))
    following = dealt.select("before", F.when(~F.col("nameless"), F.struct(start.alias("start"), digests(F.col("text")).alias("digests"))).alias("next"))
    following = following.groupBy("before").agg(F.min("next").alias("next"))
    both = docs.join(following.hint("shuffle_hash"), (F.col("at") == F.col("before")) & ~F.col("nameless"), "left")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left(F.coalesce(F.col("next.start"), F.lit("")), cut))
    both = both.select("at", "nameless", F.monotonically_increasing_id().alias("row_nr"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("next.digests").alias("next_digests"))
    texts = {"own": digests(F.col("text")), "edited": digests(F.col("edited")), "next": F.coalesce("next_digests", F.array().cast(DIGESTS))}
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    out = compare_texts(both, ["at", "row_nr"], ["nameless", "n_chars", "edited_sha256"], texts, [("own", "edited"), ("own", "next")], ["own", "edited"])
    return out.select(
        F.when(~F.col("nameless"), F.col("at")).alias("doc_id"), "n_chars", "edited_sha256", F.col("own_fingerprint").alias("fingerprint"),
        "edited_fingerprint", F.col("near_own_edited").alias("near_edited"), F.col("near_own_next").alias("near_next"),
    )
