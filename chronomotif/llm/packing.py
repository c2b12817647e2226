"""Best-fit packing of token sequences in bulk-synchronous rounds (operator 11).

Documents are encoded once; those longer than a sequence are cut, and what is
shorter than one becomes an item to pack. In each round items and gaps are
sorted together by size, dealt out as ranges, and swept from large to small:

1. Each range is swept by itself: an item goes into the smallest gap of the
   range that holds it, and what is left of the gap stays open.
2. Items left over have their successors in ranges of larger gaps. The ranges'
   counts, a row for each range, tell which ranges meet; inside a pair of ranges
   the conflict over gaps is resolved by rank, so that an item's gap follows
   from its rank, and a gap that surely holds several of the range's items gets
   as many.
3. Gaps shrink by what they got; gaps too small for every item close; items
   larger than every gap get new sequences, no more than their total needs.

Rounds end when no item is left.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import materialize, release, scan, share_package, ship, shipped, table, text_or_empty, tokenizer_path

MODEL = "byte_bpe_50k.json"
WINDOW = 1024
END_ID = 2
#: Rows of a range at least, and ranges at most: rows of a range grow beyond that, a row for each range goes to the driver.
RANGE_ROWS, RANGES = 16_384, 4_096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words remembered in a worker, and letters of those that are.
CACHE_WORDS, CACHE_LETTERS = 400_000, 48
#: What byte-level vocabularies split texts by before they merge (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str):
    """The vocabulary of a byte-level BPE file as ranks of byte strings, which encode short texts faster; None for other files.

    Ids must count the bytes first, then the merges in their order, which makes
    an id the rank of its merge.
    """
    import tiktoken

    held = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = held["model"], held["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and not held["normalizer"]
    if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return None
    # Bytes that print as Latin-1 letters stand for themselves, the others for letters from 256 on, in order.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None


class WordIds(dict):
    """Ids, as little-endian bytes, of a word with what is written before it; missing ones are encoded.

    A word ends where a blank follows that isn't among other white space. The
    tokenizer's own pattern ends a token there, whatever surrounds it, so that
    a text's ids are those of its words. Words that are met again outlast others.
    """

    def __init__(self, encode, before: str) -> None:
        self.encode, self.before = encode, before
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or array("I", self.encode(self.before + word)).tobytes()
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, by words."""

    #: A blank among white space: the words around it aren't independent.
    INNER = re.compile(r"\s \s")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        fast = ranked(path)
        one = fast.encode_ordinary if fast else self.whole
        self.first, self.later = WordIds(one, ""), WordIds(one, " ")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Ids of four bytes each, the lowest first."""
        if not text:
            return b""
        if self.special.search(text):
            return array("I", self.whole(text)).tobytes()
        # Inside runs of white space only blanks between two other characters divide.
        words = re.split(r"(?<=\S) (?=\S)", text) if self.INNER.search(text) else text.split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids with an end id, cut where they exceed a window; the first piece takes what is left over."""
    spark = df.sparkSession
    share_package(spark)
    path = model or tokenizer_path(MODEL)
    ship(spark, path)
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped(path))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + end
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % window or window
                    out.append((doc_id, piece, at, length, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    return texts.mapInArrow(cut, PIECES)


class Deal(NamedTuple):
    """Which range a row belongs to: by its size the first range, and over how many ranges rows of that size are spread."""

    first: list[int]
    over: list[int]
    ranges: int

    def range_of(self, size: Column, of: Column) -> Column:
        spread = F.get(F.lit(self.over), size.cast("int"))
        return F.get(F.lit(self.first), size.cast("int")) + F.pmod(F.xxhash64(of), spread).cast("int")


def deal(counts: dict[int, int], window: int, range_rows: int = RANGE_ROWS) -> Deal:
    """Ranges of near even numbers of rows, from large sizes to small; sizes that alone exceed a range have several."""
    most = max(range_rows, -(-sum(counts.values()) // RANGES))
    first, over, at, held = [0] * (window + 1), [1] * (window + 1), 0, 0
    for size in range(window, -1, -1):
        n = counts.get(size, 0)
        if held and held + n > most:
            at, held = at + 1, 0
        first[size], over[size] = at, -(-n // most) or 1
        held += n
        if over[size] > 1:
            at, held = at + over[size], 0
    return Deal(first, over, at + 1)


def fill(sizes: np.ndarray, is_gap: np.ndarray, lowest: int) -> tuple[list[tuple[int, int, int]], list[int], dict[int, int]]:
    """Best fit within one range, rows sorted from large to small and gaps before items of their size.

    Gives placements (item, gap, gap's size before), items left over in order,
    and what is left of each gap that is still open, ``lowest`` being the range's
    smallest size: what falls below it belongs to another range.
    """
    open_: list[list[int]] = [[] for _ in range(int(sizes.max(initial=0)) + 1)]
    mask = 0
    placed, rest, left = [], [], {}
    for row, (size, gap) in enumerate(zip(sizes.tolist(), is_gap.tolist(), strict=True)):
        if gap:
            open_[size].append(row)
            mask |= 1 << size
            left[row] = size
            continue
        larger = mask >> size
        if not larger:
            rest.append(row)
            continue
        held = size + (larger & -larger).bit_length() - 1
        into = open_[held].pop()
        if not open_[held]:
            mask ^= 1 << held
        placed.append((row, into, held))
        left[into] = held - size
        if held - size >= lowest:
            open_[held - size].append(into)
            mask |= 1 << (held - size)
    return placed, rest, left


#: What a sweep puts out. kind: "placed" (with its sequence and place), "item" (with its rank in the range, largest first),
#: "gap" (with its rank in the range, smallest first; null where it left the range).
SWEPT = "kind string, range int, id long, size long, seq long, at long, rank long"


def _sweep(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "is_gap", "id"], ascending=[False, False, True], kind="stable", ignore_index=True)
        sizes, ids, is_gap = rows["size"].to_numpy(), rows["id"].to_numpy(), rows["is_gap"].to_numpy()
        lowest, of = int(sizes.min()), int(rows["range"].iat[0])
        placed, rest, left = fill(sizes, is_gap, lowest)
        item, into, held = (np.array(x, np.int64) for x in (zip(*placed, strict=True) if placed else ((), (), ())))
        gap, now = np.fromiter(left.keys(), np.int64, len(left)), np.fromiter(left.values(), np.int64, len(left))
        order = np.lexsort((ids[gap], now))
        gap, now = gap[order], now[order]
        rest_, inside = np.array(rest, np.int64), now >= lowest
        n = (len(item), len(rest_), len(gap))
        shown = lambda *parts: pd.concat([pd.Series(p, dtype="Int64") for p in parts], ignore_index=True)
        none = lambda k: [pd.NA] * k
        return pd.DataFrame(
            {
                "kind": np.repeat(["placed", "item", "gap"], n),
                "range": np.full(sum(n), of, np.int32),
                "id": np.concatenate([ids[item], ids[rest_], ids[gap]]),
                "size": np.concatenate([sizes[item], sizes[rest_], now]),
                "seq": shown(ids[into], none(n[1] + n[2])),
                "at": shown(window - held, none(n[1] + n[2])),
                "rank": shown(none(n[0]), np.arange(n[1]), pd.Series(np.cumsum(inside) - 1, dtype="Int64").where(pd.Series(inside))),
            }
        )

    return run


class Range(NamedTuple):
    """A range after its own sweep: items left over and their largest size, gaps still in it and their smallest size."""

    range: int
    items: int
    largest: int
    gaps: int
    smallest: int


#: Items of one range, by rank, that go to gaps of another, by rank, ``each`` to a gap.
Meeting = tuple[int, int, int, int, int, int]


def meetings(ranges: Iterable[Range]) -> list[Meeting]:
    """``range, from, until, gap_range, first_gap, each``: the sweep over ranges, from large to small, each taking the nearest larger gaps."""
    out: list[Meeting] = []
    stack: list[list[int]] = []  # gap range, next rank, gaps, smallest
    for r in sorted(ranges):
        rank = 0
        while rank < r.items and stack:
            top = stack[-1]
            each = max(1, top[3] // r.largest)
            used = min(top[2] - top[1], -(-(r.items - rank) // each))
            until = min(r.items, rank + used * each)
            out.append((r.range, rank, until, top[0], top[1], each))
            rank, top[1] = until, top[1] + used
            if top[1] == top[2]:
                stack.pop()
        if r.gaps:
            stack.append([r.range, 0, r.gaps, r.smallest])
    return out


def _matched(swept: DataFrame, met: list[Meeting], window: int) -> DataFrame:
    """The rows of a round after ranges have met: ``kind`` "placed" (``id, seq, at``), "item" or "gap" (``id, size``).

    The table of meetings has at most two rows for each range, and is sent to every task.
    """
    spark = swept.sparkSession
    met_table = F.broadcast(spark.createDataFrame(met, "of int, low long, high long, gap_range int, first_gap long, each long"))
    rank = F.col("rank")
    items = swept.filter("kind = 'item'").join(met_table, (F.col("range") == F.col("of")) & (rank >= F.col("low")) & (rank < F.col("high")), "left")
    nth = rank - F.col("low")
    items = items.select("id", "size", "gap_range", (F.col("first_gap") + F.floor(nth / F.col("each"))).cast("long").alias("gap_rank"), F.pmod(nth, F.col("each")).alias("slot"))
    # A gap gets no more items than fit.
    got = items.filter("gap_range is not null").groupBy("gap_range", "gap_rank").agg(F.array_sort(F.collect_list(F.struct("slot", "id", "size"))).alias("got"))
    gaps = swept.filter("kind = 'gap' and rank is not null").select("id", "size", F.col("range").alias("gap_range"), F.col("rank").alias("gap_rank"))

    def place(at: Column, x: Column) -> Column:
        put = F.struct(F.lit("placed").alias("kind"), x["id"].alias("id"), x["size"].alias("size"), F.col("id").alias("seq"), at.alias("at"))
        return F.struct((at + x["size"]).alias("state"), put.alias("out"))

    row = "struct<kind:string,id:bigint,size:bigint,seq:bigint,at:bigint>"
    filled = gaps.join(got, ["gap_range", "gap_rank"]).withColumn("placed", scan(F.col("got"), F.lit(window) - F.col("size"), place, row))
    taken = F.aggregate("got", F.lit(0).cast("long"), lambda n, x: n + x["size"])
    nothing = F.lit(None).cast("long")
    shrunk = F.struct(F.lit("gap").alias("kind"), F.col("id"), (F.col("size") - taken).alias("size"), nothing.alias("seq"), nothing.alias("at"))
    filled = filled.select(F.explode(F.concat("placed", F.array(shrunk))).alias("r")).select("r.*")
    untouched = gaps.join(got.select("gap_range", "gap_rank"), ["gap_range", "gap_rank"], "left_anti").select("id", "size")
    gone = swept.filter("kind = 'gap' and rank is null").select("id", "size")
    still = untouched.unionByName(gone).select(F.lit("gap").alias("kind"), "id", "size", nothing.alias("seq"), nothing.alias("at"))
    over = items.filter("gap_range is null").select(F.lit("item").alias("kind"), "id", "size", nothing.alias("seq"), nothing.alias("at"))
    alone = swept.filter("kind = 'placed'").select("kind", "id", "size", "seq", "at")
    return alone.unionByName(filled).unionByName(still).unionByName(over)


def best_fit(items: DataFrame, window: int = WINDOW, range_rows: int = RANGE_ROWS) -> DataFrame:
    """From ``id, size`` with distinct ids and sizes from 1 to the window: ``id, sequence_id, offset``.

    Sequences are numbered from 0. An empty table gives an empty result.
    """
    spark = items.sparkSession
    share_package(spark)
    rows = items.select(F.lit("item").alias("kind"), F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size"))
    rounds: list[DataFrame] = []
    opened = 0
    while True:
        # Rows by kind and size: at most two for each size.
        counts = rows.filter("kind <> 'placed'").groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
        wanted = {r["size"]: r["n"] for r in counts if r["kind"] == "item"}
        if not wanted:
            break
        least = min(wanted)
        gaps = {r["size"]: r["n"] for r in counts if r["kind"] == "gap" and r["size"] >= least}
        homeless = {s: n for s, n in wanted.items() if s > max(gaps, default=0)}
        both = rows.filter("kind <> 'placed'").filter(F.col("size") >= least).select("id", "size", (F.col("kind") == "gap").alias("is_gap"))
        if homeless:
            new = max(sum(n for s, n in homeless.items() if 2 * s > window), -(-sum(s * n for s, n in homeless.items()) // window))
            both = both.unionByName(spark.range(opened, opened + new).select("id", F.lit(window).cast("long").alias("size"), F.lit(True).alias("is_gap")))
            gaps[window] = gaps.get(window, 0) + new
            opened += new
        dealt = deal({s: wanted.get(s, 0) + gaps.get(s, 0) for s in {*wanted, *gaps}}, window, range_rows)
        both = both.withColumn("range", dealt.range_of(F.col("size"), F.col("id")))
        swept = materialize(both.groupBy("range").applyInPandas(_sweep(window), SWEPT), "pack-swept")
        is_item, in_range = F.col("kind") == "item", (F.col("kind") == "gap") & F.col("rank").isNotNull()
        told = swept.groupBy("range").agg(
            F.count_if(is_item).alias("items"), F.max(F.when(is_item, F.col("size"))).alias("largest"), F.count_if(in_range).alias("gaps"), F.min(F.when(in_range, F.col("size"))).alias("smallest")
        )
        met = meetings(Range(r["range"], r["items"], r["largest"] or 0, r["gaps"], r["smallest"] or 0) for r in told.collect())
        rows = materialize(_matched(swept, met, window), "pack-round")
        release(swept)
        rounds.append(rows)
    out = spark.createDataFrame([], "id long, sequence_id long, offset long")
    for done in rounds:
        out = out.unionByName(done.filter("kind = 'placed'").select("id", F.col("seq").alias("sequence_id"), F.col("at").alias("offset")))
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, window: int = WINDOW, end_id: int = END_ID, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``df``.

    A null text is an empty one, its end id alone; null ids and repeated rows
    are packed each; pieces that fill a window have a sequence to themselves,
    with a negative number; an empty table gives an empty result. Other columns
    are not read.
    """
    cut = materialize(pieces(df, id_col, text_col, model, window, end_id).withColumn("id", F.monotonically_increasing_id()), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = cut.filter(F.col("length") == window).select(*names, (-1 - F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shorter = cut.filter(F.col("length") < window)
    placed = best_fit(shorter.select("id", F.col("length").alias("size")), window, range_rows)
    return whole.unionByName(shorter.join(placed, "id").select(*names, "sequence_id", "offset"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
