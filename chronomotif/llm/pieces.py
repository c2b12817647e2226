"""SentencePiece encoding and decoding by a prefix table (operator 1).

A merge-type (BPE) model gives every prefix of a string one encoding, so each
prefix has one last token. The table of last tokens is filled from left to
right: an automaton over the vocabulary names the tokens that end at a
position, and the one that may stand there is the one whose pair with the last
token of the prefix before it survives merging. Ids are recovered by walking
the table backwards. Nothing is re-merged for the string as a whole, so a long
string costs time in proportion to its length.

No vocabulary entry has a space mark after another character, nor a line
break, so a text falls apart into units there, and units repeat: their ids are
kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import share_package, ship, shipped, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: A code point that no valid text has.
FIRST = "\ud800"
BREAK = f" {FIRST}\n {FIRST}"
#: Units and token pairs whose results a worker keeps before it starts anew.
UNITS_KEPT = 600_000
PAIRS_KEPT = 1_000_000


class PieceEncoder:
    """Encodes as the library does for an identity-normalised BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {self.text[i]: i for i in range(n) if i not in special}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.eos = sp.eos_id()
        probe = ["a b", " a  b ", "", "\t\n\r a\u00a0b\u3000\u200b\ufeff", "\ufb01 e\u0301 \uff21 \u2460 \u00c5", "漢字かな 한글 İıẞ", "\u0000\u0001\ud7ff\U0010ffff"]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("the vocabulary joins text across a space mark or line break")
        if any(sp.normalize(t) != (SPACE + t.replace(" ", SPACE) if t else "") for t in probe):
            raise ValueError("the model rewrites its input beyond marking spaces")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.split = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.pairs: dict[int, bool] = {}
        self.width = n
        self.whole: dict[int, bool] = {}
        self.units = _Units(self)

    def _merged(self, chars: list[str]) -> list[str]:
        """Best-scored pair first, leftmost on ties, until no pair is a piece."""
        ids, score = self.ids, self.score
        while len(chars) > 1:
            best, at = None, -1
            for k in range(len(chars) - 1):
                i = ids.get(chars[k] + chars[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                return chars
            chars[at : at + 2] = [chars[at] + chars[at + 1]]
        return chars

    def _stands(self, i: int) -> bool:
        """Whether merging the characters of token ``i`` leads to that token."""
        known = self.whole.get(i)
        if known is None:
            known = self.whole[i] = len(self._merged(list(self.text[i]))) == 1
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart when their text is merged afresh."""
        key = a * self.width + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[key] = self._merged(list(x + y)) == [x, y]
        return known

    def unit(self, s: str) -> tuple[int, ...]:
        """Ids of one unit by the prefix table."""
        n = len(s)
        last = [-1] * (n + 1)
        pairs, width = self.pairs, self.width
        for at, (length, i) in self.automaton.iter(s):
            if last[at + 1] < 0:
                start = at + 1 - length
                before = last[start]
                if start == 0 or before < 0:
                    fits = self._stands(i)
                else:
                    fits = pairs.get(before * width + i)
                    if fits is None:
                        fits = self._compatible(before, i)
                if fits:
                    last[at + 1] = i
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
                n -= len(self.text[last[n]])
            else:  # a character outside the vocabulary
                out.extend(self.byte[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass")))
                n -= 1
        out.reverse()
        return tuple(out)

    def words(self, text: str) -> list[str]:
        """Keys into ``units`` whose values, joined, encode a text that isn't empty.

        Where spaces and line breaks stand singly, a plain split at spaces does;
        FIRST marks a word that no space mark goes before.
        """
        if SPACE not in text:
            words = text.replace("\n", BREAK).split(" ")
            if "" not in words and FIRST not in words:
                return words
        return [FIRST + u for u in self.split(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.units.__getitem__, self.words(text)))) if text else []

    def count(self, text: str) -> int:
        return sum(map(len, map(self.units.__getitem__, self.words(text)))) if text else 0


class _Units(dict):
    """Ids by unit; starts anew when full."""

    def __init__(self, encoder: PieceEncoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= UNITS_KEPT:
            self.clear()
        ids = self.encoder.unit(word[1:] if word[0] == FIRST else SPACE + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each process and model."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_text: bool = True) -> DataFrame:
    """One row per input row: its id, ids with an end id, and the decoded text.

    A null text counts as empty; a null id stays null; repeated rows are
    encoded each; an empty table gives an empty result; other columns,
    whatever their names, are neither read nor returned. With
    ``with_text=False`` the ids and the text are returned as SHA-256 digests
    only (columns ``ids_sha256`` and ``decoded_sha256``).
    """
    path = model or tokenizer_path(MODEL)
    share_package(df.sparkSession)
    ship(df.sparkSession, path)
    kind = df.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped(path))
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
                for text in part.column(1):
                    ids = enc.encode(text.as_py() or "")
                    decoded = enc.library.decode(ids)
                    ids.append(enc.eos)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if with_text:
                        all_ids.append(ids)
                        texts.append(decoded)
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    small = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), with_text=False)
