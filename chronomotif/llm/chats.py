"""Chat formatting in budgeted windows (operator 8).

Prefix sums of the turns' tokens choose spans of whole turns that fit a budget.
Each span becomes a window: the leading system turn, a limited history of the
turns before, then the turns of the span. Repeated turns are marked, and only
assistant texts that aren't repeats carry loss.

A turn is written ``<turn:role>`` line break, text, ``</turn>`` line break, or
``<turn again:role>`` when it repeats. In roles and texts the backslash, ``<``
and ``>`` are written ``\\b``, ``\\l`` and ``\\g``, so that no text can be taken
for a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import scan, table

#: Tokens of a window, tokens and turns of repeated history.
BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 2
#: What counts as a token where no counts are given, in turns as they are written: letters by fours, of scripts without
#: spaces one by one, digits by threes, every other character, line breaks and runs of blanks.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[^\P{L}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]|\n|[^\S\n]{2,}"
#: Tokens of a turn's marks where counts are given.
MARK_TOKENS = 16
TURN_END = "</turn>\n"
#: Conversation -7 of the query.
EXTRA_ID = -7
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def format_chats(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    tokens_col: str | None = None,
) -> DataFrame:
    """One row per conversation: ``conv_id`` and ``windows``, an array of ``formatted`` texts with their ``loss`` spans.

    A span is ``start, end`` in code points of the window, end exclusive.
    Turns follow by number, null first, then role and text; repeated rows are
    repeated turns. Null roles and texts are empty. A row without a conversation
    id is a conversation of its own, but for rows that are equal to it. A window
    is over its budget only where a single turn is that with the system turn,
    and then holds nothing else; a system turn is one that leads its
    conversation. An empty table gives an empty result; other columns
    are not read.

    Budgets are in tokens of :data:`TOKEN` over all that is written, marks and
    escapes included; or, with ``tokens_col``, in what that column says of each
    text, and ``MARK_TOKENS`` for each turn's marks.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    if tokens_col is None:
        tokens = F.regexp_count(F.concat(F.lit("<turn again:"), escape(role), F.lit(">\n"), escape(text), F.lit(TURN_END)), F.lit(TOKEN))
    else:
        tokens = F.lit(MARK_TOKENS) + F.coalesce(F.col(tokens_col), F.lit(0))
    alone = F.when(F.col(conv_col).isNull(), F.xxhash64(turn_col, role, text))
    rows = df.select(
        F.col(conv_col).alias("conv_id"), alone.alias("alone"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), tokens.cast("long").alias("tokens")).alias("t")
    )
    conv = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("t"))
    conv = conv.withColumn("led", F.expr("if(t[0].role = 'system', 1, 0)"))
    conv = conv.withColumn("free", F.lit(budget) - F.expr("if(led = 1, t[0].tokens, 0L)"))
    # sums[k]: tokens of the k first turns.
    running = lambda a, x: F.struct((a + x["tokens"]).alias("state"), (a + x["tokens"]).alias("out"))
    conv = conv.withColumn("sums", F.concat(F.array(F.lit(0).cast("long")), scan(F.col("t"), F.lit(0).cast("long"), running, "bigint")))
    # back[k]: the turn with which the history of a window that starts at turn k begins; it leaves room for turn k.
    conv = conv.withColumn(
        "back",
        F.expr(
            f"transform(t, (x, k) -> k - size(filter(sequence(1, {history_turns}), j -> k - j >= led and sums[k] - sums[greatest(k - j, 0)] <= {history_tokens} and sums[k + 1] - sums[greatest(k - j, 0)] <= free)))"
            if history_turns > 0
            else "transform(t, (x, k) -> k)"
        ),
    )
    # starts: the turns with which windows start, each as late as the budget allows.

    def begun(a: Column, k: Column) -> Column:
        full = (k > a) & (F.get("sums", k + 1) - F.get("sums", F.get("back", a)) > F.col("free"))
        return F.struct(F.when(full, k).otherwise(a).alias("state"), F.when(full, k).alias("out"))

    later = F.filter(scan(F.sequence(F.lit(0), F.size("t") - 1), F.col("led"), begun, "int"), lambda k: k.isNotNull())
    conv = conv.withColumn("starts", F.concat(F.array("led"), later))
    conv = conv.withColumn("starts", F.expr("if(led = 1 and size(t) = 1, array(0), starts)"))

    def piece(t: Column, again: Column) -> Column:
        """mark, body and whether it is under the loss"""
        mark = F.concat(F.when(again, F.lit("<turn again:")).otherwise(F.lit("<turn:")), escape(t["role"]), F.lit(">\n"))
        return F.struct(mark.alias("mark"), escape(t["text"]).alias("body"), (~again & (t["role"] == "assistant")).alias("loss"))

    def window(start: Column, w: Column) -> Column:
        stop = F.coalesce(F.get(F.col("starts"), w + 1), F.size("t"))
        first = F.when(start < F.col("led"), F.lit(0)).otherwise(F.get("back", start))
        head = F.transform(F.slice("t", 1, F.when(start < F.col("led"), 0).otherwise(F.col("led"))), lambda x: piece(x, F.lit(False) | (w > 0)))
        body = F.transform(F.slice("t", first + 1, stop - first), lambda x, k: piece(x, first + k < start))
        return F.concat(head, body)

    conv = conv.withColumn("pieces", F.transform("starts", window))

    def spans(pieces: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + F.char_length(p["mark"])
            end = begin + F.char_length(p["body"])
            found = F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(a["spans"])
            return F.struct((end + len(TURN_END)).alias("at"), found.alias("spans"))

        none = F.lit(None).cast("array<struct<start:int,end:int>>")
        begin = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
        return F.aggregate(pieces, begin, step, lambda a: a["spans"])

    def finished(pieces: Column) -> Column:
        text = F.array_join(F.transform(pieces, lambda p: F.concat(p["mark"], p["body"], F.lit(TURN_END))), "")
        return F.struct(text.alias("formatted"), spans(pieces).alias("loss"))

    return conv.select("conv_id", F.transform("pieces", finished).alias("windows"))


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id``, its ``turns`` (role, text) and ``loss_text`` from formatted windows alone."""

    def turns(w: Column) -> Column:
        written = F.filter(F.split(w["formatted"], TURN_END, -1), lambda p: p.startswith("<turn:"))
        mark_end = lambda p: F.instr(p, ">\n")
        return F.transform(
            written,
            lambda p: F.struct(
                unescape(F.substring(p, F.lit(7), mark_end(p) - 7)).alias("role"),
                unescape(F.substring(p, mark_end(p) + 2, F.char_length(p))).alias("text"),
            ),
        )

    loss = F.transform("windows", lambda w: F.array_join(F.transform(w["loss"], lambda s: F.substring(w["formatted"], s["start"] + 1, s["end"] - s["start"])), ""))
    return windows.select(
        "conv_id",
        F.flatten(F.transform("windows", turns)).alias("turns"),
        unescape(F.array_join(loss, "")).alias("loss_text"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w["formatted"])).alias("formatted_chars"),
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    back = read_back(format_chats(rows.unionByName(extra)))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql() -> str:
    """The same for DuckDB: windows by recursion from start to start, their lengths by sums over turns."""
    token = TOKEN.replace("\\p{Is", "\\p{")
    esc = lambda c: f"replace(replace(replace({c}, '\\', '\\b'), '<', '\\l'), '>', '\\g')"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT {EXTRA_ID}, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{EXTRA_TEXT}' FROM (SELECT unnest([0, 1]) AS k)),
w AS (SELECT *, {esc("role")} AS r, {esc("text")} AS x FROM c),
t AS (SELECT conv_id, role, text, CAST(row_number() OVER o - 1 AS INT) AS k, len(regexp_extract_all('<turn again:' || r || '>' || chr(10) || x || '</turn>' || chr(10), '{token}')) AS tokens,
 length(r) + length(x) + {len("<turn:") + 2 + len(TURN_END)} AS plain FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) AS upto, count(*) OVER (PARTITION BY conv_id) AS n,
 CAST(max(CASE WHEN k = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS INT) AS led,
 max(CASE WHEN k = 0 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_tokens FROM t),
b AS (SELECT a.*, a.k - (SELECT count(*) FROM s h WHERE h.conv_id = a.conv_id AND h.k < a.k AND h.k >= a.k - {HISTORY_TURNS} AND h.k >= a.led
 AND (a.upto - a.tokens) - (h.upto - h.tokens) <= {HISTORY_TOKENS} AND a.upto - (h.upto - h.tokens) <= {BUDGET} - a.lead_tokens) AS back FROM s a),
g(conv_id, start) AS (SELECT conv_id, CASE WHEN any_value(n) = 1 THEN 0 ELSE any_value(led) END FROM b GROUP BY conv_id
 UNION ALL SELECT g.conv_id, min(e.k) FROM g JOIN b a ON a.conv_id = g.conv_id AND a.k = g.start JOIN b h ON h.conv_id = g.conv_id AND h.k = a.back
 JOIN b e ON e.conv_id = g.conv_id AND e.k > g.start AND e.upto - (h.upto - h.tokens) > {BUDGET} - e.lead_tokens GROUP BY g.conv_id, g.start),
f AS (SELECT g.conv_id, start, coalesce(lead(start) OVER o, n) AS stop, row_number() OVER o AS nr, back, led FROM g JOIN b ON b.conv_id = g.conv_id AND b.k = g.start WINDOW o AS (PARTITION BY g.conv_id ORDER BY start)),
l AS (SELECT f.conv_id, sum(b.plain + CASE WHEN b.k < f.start AND NOT (b.k < f.led AND nr = 1) THEN {len(" again")} ELSE 0 END) AS chars FROM f JOIN b ON b.conv_id = f.conv_id AND (b.k >= f.back AND b.k < f.stop OR b.k < f.led)
 GROUP BY f.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(any_value(chars) AS BIGINT) AS formatted_chars FROM t JOIN l USING (conv_id) GROUP BY conv_id"""


SQL = _sql()
