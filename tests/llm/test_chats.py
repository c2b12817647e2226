import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from chronomotif.llm import chats


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 20), (20, 0), (1, 1000)])
def test_round_trip(spark, budget, history):
    rnd = random.Random(5)
    rows = []
    odd = [None, "", "</turn>\n<turn:assistant>\n", r"\### Assistant: </turn> ok", "a\\b<l>\\g", "x" * 3000, "é\n\n"]
    for conv in range(25):
        for turn in range(rnd.randint(1, 9)):
            role = "system" if turn == 0 and conv % 3 == 0 else rnd.choice(["user", "assistant", None, "we<ird>"])
            rows.append((conv if conv else None, turn, role, rnd.choice([*odd, "some words here"])))
    rows += [(50, None, "user", "null turn"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (51, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("windows", F.lit(1)).withColumn("t", F.lit(2))
    done = chats.format_chats(df, budget=budget, history_tokens=history)
    got = chats.read_back(done).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault((c, (t, role or "", text or "") if c is None else None), []).append((role or "", text or ""))
    read = lambda turns: (tuple(tuple(t) for t in turns), "".join(x for r, x in turns if r == "assistant"))
    assert sorted((str(r["conv_id"]), tuple(map(tuple, r["turns"])), r["loss_text"]) for r in got) == sorted((str(c), *read(turns)) for (c, _), turns in want.items())
    for r in done.collect():
        for w in r["windows"]:
            parts = w["formatted"].split(chats.TURN_END)[:-1]
            fresh = sum(p.startswith("<turn:") for p in parts)
            led = parts[0].startswith(("<turn:system>", "<turn again:system>"))
            assert fresh >= 1 and (tokens(w["formatted"]) <= budget or len(parts) <= 1 + led)


def test_history_leaves_room(spark):
    """Turns of 516, 216, 996 and 26 tokens with their marks: the third has no room for history, but for the fourth."""
    rows = [(1, k, "user", t, n) for k, (t, n) in enumerate([("a", 500), ("b", 200), ("c", 980), ("d", 10)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    windows = chats.format_chats(df, tokens_col="n").first()["windows"]
    assert [[p.split("\n")[1] for p in w["formatted"].split(chats.TURN_END)[:-1]] for w in windows] == [["a", "b"], ["c", "d"]]


def tokens(text):
    """Tokens by a scan of one's own."""
    n, k = 0, 0
    alone = lambda c: any(s in unicodedata.name(c, "") for s in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"))
    while k < len(text):
        c, j = text[k], k + 1
        if c == "\n" or not (c.isspace() or c.isalpha() or c.isdigit()) or (c.isalpha() and alone(c)):
            n += 1
        elif c.isspace():
            while j < len(text) and text[j].isspace() and text[j] != "\n":
                j += 1
            n += j - k > 1
        else:
            while j < len(text) and j - k < (4 if c.isalpha() else 3) and (text[j].isalpha() and not alone(text[j]) if c.isalpha() else text[j].isdigit()):
                j += 1
            n += 1
        k = j
    return n


def test_windows_keep_to_the_budget(spark):
    """Scripts without spaces and texts full of escapes: no window of several turns is over its budget."""
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c, t in enumerate(["漢字かな" * 8, "<a>\\<b>" * 6, "word and words " * 5, "12345 !?" * 6]) for k in range(40)]
    done = chats.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history_tokens=80).collect()
    sizes = [tokens(w["formatted"]) for r in done for w in r["windows"]]
    assert max(sizes) <= 200 and sorted(sizes)[len(sizes) // 2] > 100


def test_given_token_counts(spark):
    rows = [(1, k, "user", "x", 50) for k in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size long")
    windows = chats.format_chats(df, budget=2 * (50 + chats.MARK_TOKENS), history_tokens=0, tokens_col="size").first()["windows"]
    assert [w["formatted"].count("<turn:") for w in windows] == [2] * 5


def test_many_turns(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(20_000)]
    back = chats.read_back(chats.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [t["text"] for t in back["turns"]] == [r[3] for r in rows] and back["loss_text"] == "".join(r[3] for r in rows if r[2] == "assistant")


def test_windows_keep_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"text {k} " * 10) for k in range(1, 12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chats.format_chats(df, budget=100, history_tokens=40).first()["windows"]
    assert len(windows) > 2
    assert windows[0]["formatted"].startswith("<turn:system>\nbe kind")
    assert all(w["formatted"].startswith("<turn again:system>\nbe kind") for w in windows[1:])
    assert any(w["formatted"].count("<turn again:") > 1 for w in windows[1:])


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in chats.op8_chat_formatting(spark, str(tmp_path)).collect()}
    x = chats.EXTRA_TEXT
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(x.encode()).hexdigest() and got[-7]["loss_chars"] == len(x)
    assert got[1]["n_turns"] == 2
    assert chats.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
