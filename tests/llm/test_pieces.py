import hashlib
import random

import pytest

from chronomotif.llm.common import tokenizer_path
from chronomotif.llm.pieces import MODEL, encode_decode, encoder

CASES = ["", " ", "  ", "a", " a", "a  b", "a \n b\n\nc ", "▁x", "x ▁ y", "퟿\U0001f600", "\x00", "<s></s>", "x" * 3000, "ab " * 5000, " " * 70, "\n" * 40, "日本語 текст", "a\xa0b　c", "-" * 777]


@pytest.fixture(scope="module")
def enc():
    return encoder(tokenizer_path(MODEL))


@pytest.mark.parametrize("text", CASES)
def test_ids_are_the_librarys(enc, text):
    assert enc.encode(text) == enc.library.encode(text)
    assert enc.count(text) == len(enc.library.encode(text))


def test_random_texts(enc):
    rnd = random.Random(3)
    pieces = list(enc.ids)
    for _ in range(1500):
        s = "".join(rnd.choice(pieces).replace("▁", " ") for _ in range(rnd.randint(1, 6)))
        assert enc.encode(s) == enc.library.encode(s)
        s = "".join(rnd.choice("ab cdeAB \n\t.,19▁éü漢<>") for _ in range(rnd.randint(0, 25)))
        assert enc.encode(s) == enc.library.encode(s)


def test_operator(spark, enc):
    rows = [(1, "the cat sat", "x"), (2, None, "y"), (None, "", "z"), (4, "the cat sat", "x"), (4, "the cat sat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_decode(df).collect()
    assert len(out) == 5
    for r in out:
        text = "" if r["doc_id"] in (2, None) else "the cat sat"
        ids = [*enc.library.encode(text), enc.eos]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert encode_decode(df.limit(0), with_text=False).count() == 0
