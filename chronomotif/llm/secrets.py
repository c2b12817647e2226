"""Secret scans with sliding-window entropy (operator 2).

Patterns find assignments, access keys and hex strings. Besides, runs of the
characters of a class are candidates: a window slides over each, keeping the
count of every character and the sum of c*log2(c) up to date by the character
that enters and the one that leaves, which gives the window's Shannon entropy.
A candidate with a window above its class's threshold is a finding from the
first such window to the last, unless the allow list knows the candidate.

All of it is column expressions; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import bound, scan, table, text_or_empty

#: Fixed by the contract: kind, pattern, group measured, least length of it.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # Greedy runs: one that is long enough is the same with the bound in the pattern.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
WINDOW = 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: Kind, characters of the class, pattern of a candidate, bits from which a window counts.
CLASSES = (
    ("entropy_hex", DIGITS + "ABCDEFabcdef", rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{WINDOW},}}", 3.0),
    ("entropy_base64", LETTERS + DIGITS + "+/_=-", rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{{WINDOW},}}", 3.85),
)
#: Candidates that look random but aren't secret.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"(?i)example|placeholder|changeme",
    r"^sha(1|256|384|512)-",
    r"(?i)abcdefghij|0123456789",
    r"^//",
)
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _spans(text: Column, pattern: str, kind: int, groups: dict[str, int], keep) -> Column:
    """Spans of a pattern's matches, for which ``keep``, of a struct of their groups, gives start and stop within the match, or null.

    The text is matched once for each group and once for what lies between;
    the arrays are bound, and a running sum of lengths tells where matches
    begin, so that time is in proportion to the text.
    """
    every = {"whole": 0} | groups
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(name) for name, g in every.items()]
    matches = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(parts[0])).alias("gap"), *parts)

    def step(at: Column, m: Column) -> Column:
        start = at + F.char_length(m["gap"])
        return F.struct((start + F.char_length(m["whole"])).alias("state"), F.struct(start.alias("start"), keep(m).alias("inner")).alias("out"))

    def placed(found: Column) -> Column:
        # Matches that fail take no part in what follows; two shifts of one start make a span.
        kept = F.filter(scan(found, F.lit(0), step, "struct<start:int,inner:struct<start:int,stop:int>>"), lambda x: x["inner"].isNotNull())
        return F.transform(kept, lambda x: F.struct((x["start"] + x["inner"]["start"]).alias("start"), F.lit(kind).alias("kind"), (x["start"] + x["inner"]["stop"]).alias("stop")))

    return F.when(text.rlike(pattern), bound(matches, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, kind: int) -> Column:
    _, pattern, group, least = BASE[kind]
    whole = lambda m: F.struct(F.lit(0).alias("start"), F.char_length(m["whole"]).alias("stop"))
    return _spans(text, pattern, kind, {"part": group}, lambda m: F.when(F.char_length(m["part"]) >= least, whole(m)))


#: Counts of a window's characters are held in longs, so many bits each.
COUNT_BITS = 5
PER_LONG = 64 // COUNT_BITS


def window_hull(x: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """Start and stop of the hull of all windows of ``x`` with at least so many bits of entropy; null where none is.

    ``x`` has characters of ``alphabet`` alone. A window's counts are packed
    into a few longs; a step adds the character that enters and takes out the
    one that leaves, with what either changes in the sum of c*log2(c).
    """
    if window >= 1 << COUNT_BITS:
        raise ValueError(f"a window has fewer than {1 << COUNT_BITS} characters")
    n_log = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    # What a count of n gives to the sum when it grows, and when it shrinks, by one.
    change = {by: F.array(*(F.lit(n_log[max(n + by, 0)] - n_log[n]) for n in range(window + 1))) for by in (1, -1)}
    least = window * (math.log2(window) - bits) + 1e-9  # a window has the bits if its sum is at most this
    where = F.array(*(F.lit(alphabet.find(chr(c))) for c in range(128)))
    longs = [f"n{k}" for k in range(-(-len(alphabet) // PER_LONG))]

    def count(a: Column, place: Column) -> Column:
        of = F.lit(0).cast("long")
        for k in reversed(range(len(longs))):
            of = F.when(place < PER_LONG * (k + 1), a[longs[k]]).otherwise(of) if k < len(longs) - 1 else a[longs[k]]
        return F.call_function("shiftrightunsigned", of, place % PER_LONG * COUNT_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def moved(a: Column, place: Column, by: int) -> Column:
        one = F.call_function("shiftleft", F.lit(by).cast("long"), place % PER_LONG * COUNT_BITS)
        total = a["sum"] + F.get(change[by], count(a, place))
        return F.struct(
            *(F.when(F.floor(place / PER_LONG) == k, a[name] + one).otherwise(a[name]).alias(name) for k, name in enumerate(longs)),
            total.alias("sum"), a["start"].alias("start"), a["stop"].alias("stop"),
        )

    def folded(places: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            left = F.when(k >= window, F.get(places, k - window)).otherwise(-1)
            out = bound(left, lambda p: F.when(p >= 0, moved(a, p, -1)).otherwise(a))

            def marked(b: Column) -> Column:
                start = F.when(b["start"] < 0, k - (window - 1)).otherwise(b["start"]).alias("start")
                return F.when((k >= window - 1) & (b["sum"] <= least), F.struct(*(b[n] for n in longs), b["sum"], start, (k + 1).alias("stop"))).otherwise(b)

            return bound(out, lambda o: bound(moved(o, F.get(places, k), 1), marked))

        zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in longs), F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(places) - 1), zero, step, lambda a: F.when(a["start"] >= 0, F.struct(a["start"].alias("start"), a["stop"].alias("stop")))
        )

    return bound(F.transform(F.split(x, "", -1), lambda c: F.get(where, F.ascii(c))), folded)


def entropy_spans(text: Column, which: int, allow: tuple[str, ...] = ALLOW) -> Column:
    _, alphabet, pattern, bits = CLASSES[which]
    allowed = "|".join(f"(?:{p})" for p in allow)

    def keep(m: Column) -> Column:
        suspect = ~m["whole"].rlike(allowed) if allow else F.lit(True)
        return F.when(suspect, window_hull(m["whole"], alphabet, bits))

    return _spans(text, pattern, len(BASE) + which, {}, keep)


def kind_name(kind: Column) -> Column:
    return F.get(F.array(*(F.lit(x[0]) for x in (*BASE, *CLASSES))), kind)


def written(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    one = lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_secrets(df: DataFrame, text_col: str = "text", out_col: str = "secrets", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``df`` with a column of spans ``start, kind, stop`` by start, then kind.

    ``kind`` counts ``BASE`` and then ``CLASSES``. A null or empty text has no
    spans. Every row is kept as it is, with its other columns; a column that
    already has the name of ``out_col`` is replaced.
    """
    text = text_or_empty(text_col)
    parts = [base_spans(text, k) for k in range(len(BASE))] + [entropy_spans(text, k, allow) for k in range(len(CLASSES))]
    return df.withColumn(out_col, F.array_sort(F.concat(*parts)))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with what spans cover, merged where they overlap, replaced by ``mark``.

    ``spans`` are by start. Text is taken to pieces by its characters, once,
    however many spans there are.
    """

    def step(at: Column, s: Column) -> Column:
        kept = F.struct(at.alias("from"), F.greatest(s["start"] - at, F.lit(-1)).alias("n"))
        return F.struct(F.greatest(at, s["stop"]).alias("state"), kept.alias("out"))

    def cut(found: Column) -> Column:
        # A span that begins within what is covered adds nothing: n is -1.
        kept = F.filter(scan(found, F.lit(0), step, "struct<from:int,n:int>"), lambda p: p["n"] >= 0)
        last = F.array_max(F.transform(found, lambda s: s["stop"]))
        return bound(F.split(text, "", -1), lambda c: F.array_join(F.concat(F.transform(kept, lambda p: part(c, p["from"], p["n"])), F.array(part(c, last, F.size(c)))), mark))

    part = lambda c, begin, n: F.array_join(F.slice(c, begin + 1, n), "")
    return F.when(F.size(spans) > 0, bound(spans, cut)).otherwise(text)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_entropy"),
    )


def _sql() -> str:
    """The same spans for DuckDB: matches and gaps unnested side by side, places by running sums, entropies window by window."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    allowed = "|".join(f"(?:{p})" for p in ALLOW)
    kinds = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        kinds.append(f"SELECT doc_id, {k} AS kind, '{name}' AS name, regexp_extract_all(t, {quoted(pattern)}) AS whole, regexp_extract_all(t, {quoted(pattern)}, {group}) AS part, string_split_regex(t, {quoted(pattern)}) AS gap, {least} AS least FROM d")
    for k, (name, alphabet, _, _) in enumerate(CLASSES):
        # Runs are maximal, so what must not stand before them can't.
        run = "[" + alphabet.replace(LETTERS, "A-Za-z").replace(DIGITS, "0-9").replace("-", r"\-").replace(r"A\-Z", "A-Z").replace(r"a\-z", "a-z").replace(r"0\-9", "0-9") + f"]{{{WINDOW},}}"
        kinds.append(f"SELECT doc_id, {len(BASE) + k}, '{name}', regexp_extract_all(t, {quoted(run)}), NULL, string_split_regex(t, {quoted(run)}), 0 FROM d")
    bits = "CASE kind " + " ".join(f"WHEN {len(BASE) + k} THEN {c[3]}" for k, c in enumerate(CLASSES)) + " END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({" UNION ALL ".join(kinds)}),
u AS (SELECT doc_id, kind, name, least, unnest(whole) AS whole, unnest(CASE WHEN part IS NULL THEN whole ELSE part END) AS part, unnest(gap[:len(whole)]) AS gap, unnest(range(len(whole))) AS nr FROM k WHERE len(whole) > 0),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY nr) - length(whole) AS start FROM u),
b AS (SELECT doc_id, kind, name, start, start + length(whole) AS stop FROM p WHERE kind < {len(BASE)} AND length(part) >= least),
c AS (SELECT *, list_filter(range(length(whole) - {WINDOW - 1}), lambda i: list_entropy(string_split(whole[i + 1:i + {WINDOW}], '')) >= {bits} - 1e-9) AS high FROM p
 WHERE kind >= {len(BASE)} AND NOT regexp_matches(whole, {quoted(allowed)}) AND (kind = {len(BASE)} OR regexp_matches(whole, '[0-9]'))),
s AS (SELECT * FROM b UNION ALL SELECT doc_id, kind, name, start + high[1], start + high[-1] + {WINDOW} FROM c WHERE len(high) > 0),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind >= {len(BASE)}) AS n_entropy,
 string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base,
 string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN a USING (doc_id)"""


SQL = _sql()
