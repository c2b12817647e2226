import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronomotif.llm import packing
from chronomotif.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path(packing.MODEL))


PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "b'll", "Zoë", "中文", "<|endoftext|>", "'s", "1234", "…", "\xa0", "　", "\x1c", "é", "é", "🙂", "!!", "​", "\x00", "word", "﻿"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=40))
def test_ids_are_the_librarys(encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_fall_back(monkeypatch):
    assert packing.ranked(tokenizer_path("word_bpe_49k.json")) is None


def test_memory_of_words_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    words = packing.WordIds(encoder.whole, " ")
    for k in range(200):
        assert words[f"w{k}"] == np.array(encoder.whole(f" w{k}"), "<u4").tobytes() and words["again"]
        assert len(words) + len(words.older) <= 20


def best_fit_decreasing(sizes, window):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(window - s)
    return len(gaps)


def checked(rows, window):
    """Sequences of a packing without gaps or overlaps."""
    by = {}
    for sequence, offset, size in rows:
        by.setdefault(sequence, []).append((offset, size))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= window
    return len(by)


@pytest.mark.parametrize("kind,ranges", [("mixed", 16384), ("mixed", 40), ("small", 60), ("equal", 50), ("halves", 30)])
def test_best_fit(spark, kind, ranges):
    """Every item once, and hardly more sequences than best fit makes that takes items one by one."""
    rnd = random.Random(5)
    draw = {"mixed": lambda: rnd.randint(1, 99), "small": lambda: rnd.randint(1, 6), "equal": lambda: 7, "halves": lambda: rnd.choice([50, 51, 49])}[kind]
    sizes = [draw() for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = packing.best_fit(items, 100, ranges).collect()
    assert sorted(r["id"] for r in got) == list(range(600))
    n = checked([(r["sequence_id"], r["offset"], sizes[r["id"]]) for r in got], 100)
    assert n <= 1.05 * best_fit_decreasing(sizes, 100) + 1


def test_ranges_split_a_hot_size():
    dealt = packing.deal({7: 1000, 3: 5, 2: 5, 1: 200}, 10, 100)
    assert dealt.over[7] == 10 and dealt.over[1] == 2 and dealt.over[3] == dealt.over[2] == 1
    assert dealt.first[7] < dealt.first[3] == dealt.first[2] < dealt.first[1] and dealt.first[7] + 10 <= dealt.first[3]


def test_meetings_take_the_nearest_gaps():
    R = packing.Range
    ranges = [R(0, 0, 0, 3, 90), R(1, 2, 80, 4, 40), R(2, 9, 20, 0, 0), R(3, 100, 10, 1, 5)]
    assert packing.meetings(ranges) == [(1, 0, 2, 0, 0, 1), (2, 0, 8, 1, 0, 2), (2, 8, 9, 0, 2, 4)]


def test_pack_whole_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with names of one's own."""
    texts = [None, "", "one two three " * 900, "words and more words", "words and more words", "<|endoftext|> x", "日本語" * 700]
    rows = [(k if k != 3 else None, t, "x", 5) for k, t in enumerate(texts)] + [(1, "", "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, sequence_id int")
    got = packing.pack(df, window=64).collect()
    assert got[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    checked([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    library = packing.Encoder(tokenizer_path(packing.MODEL))
    want = []
    for doc_id, text, _, _ in rows:
        ids = [*library.whole(text or ""), 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert packing.pack(df.filter("false")).count() == 0
