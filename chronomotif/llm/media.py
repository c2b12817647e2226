"""Media columns: chroma fingerprints of audio (operator 9).

A recording becomes frames of twelve pitch classes. Filters over an integral
image of the frames compare rectangles of time and pitch; each answer is cut to
two bits, and the bits of all filters make one packed integer for every
position. Two recordings are aligned by the histogram of the offsets at which
they have an integer in common, and the share of bits that differ there says
how alike they are. A query is fingerprinted from several beginnings within
the step between two frames, so that some are close to the grid of whatever it
was cut from.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import materialize, share_package, shuffle_partitions, table

#: Samples a second, of a frame, and between frames; the range of pitches looked at.
RATE, FRAME, HOP = 4000, 1024, 256
LOWEST_HZ, HIGHEST_HZ = 55.0, 1900.0
#: Frames that the widest filter spans, and filters (two bits each).
SPAN, FILTERS = 12, 16
#: Cuts between the four answers of a filter.
CUTS = (-0.35, 0.0, 0.35)
#: Beginnings of a query within a step.
PHASES = 4
#: Most bits that differ in an alignment that counts, and least share of the shorter recording that it covers.
MOST_ERROR, LEAST_OVERLAP = 0.25, 0.5
#: A code is heavy that this share of all positions have, of so many at least: who has it is compared in blocks, of recordings with about so many codes a side. Results don't depend on it.
HEAVY_SHARE, HEAVY_ROWS, HEAVY_CODES = 1 / 1024, 1000, 1 << 19
#: Codes of recordings that are compared with a query at once.
CODES_AT_ONCE = 1 << 18
#: Recordings that a task holds at a time.
ROWS_AT_ONCE = 64


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, pitch classes, frames: kinds in turn, sizes growing, pitches spread."""
    return [(k % 4, (5 * k) % 9, 2 + k % 3 if k % 4 == 3 else 3 + k % (13 - (5 * k) % 9 - 3), 4 + 2 * (k % 5)) for k in range(FILTERS)]


@cache
def _pitches(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a spectrum that are looked at, and which of the twelve pitch classes each is (1 or 0)."""
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    pitch = np.round(12 * np.log2(hz[heard] / 440.0)).astype(int) % 12
    return heard, (pitch[:, None] == np.arange(12)).astype(float)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Shares of twelve pitch classes in each frame; all alike where it is silent."""
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    heard, classes = _pitches(rate)
    out = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)[:, heard]) ** 2 @ classes
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-6), 1 / 12)


def codes(frames: np.ndarray) -> np.ndarray:
    """One packed integer for every span of frames; one span at least, the last frame lasting."""
    if len(frames) < SPAN:
        frames = np.vstack([frames, np.repeat(frames[-1:], SPAN - len(frames), 0)])
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    n = len(frames) - SPAN + 1
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    packed = np.zeros(n, np.uint32)
    for kind, low, tall, wide in _filters():
        high, half, mid = min(low + tall, 12), wide // 2, low + max(tall // 2, 1)
        if kind == 0:  # before and after
            a, b = area(0, half, low, high), area(half, wide, low, high)
        elif kind == 1:  # below and above
            a, b = area(0, wide, low, mid), area(0, wide, mid, high)
        elif kind == 2:  # crosswise
            a = area(0, half, low, mid) + area(half, wide, mid, high)
            b = area(0, half, mid, high) + area(half, wide, low, mid)
        else:  # a band and the rest
            a = area(0, wide, low, high)
            b = (area(0, wide, 0, 12) - a) * (high - low) / (12 - high + low)
        value = np.log((a + 0.05) / (b + 0.05))
        answer = sum((value >= c).astype(np.uint32) for c in CUTS)
        packed = (packed << np.uint32(2)) | (answer ^ (answer >> np.uint32(1)))
    return packed


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples, the mean of all channels on the scale of 16 bits, and the rate of a WAV file of 8, 16, 24 or 32-bit integers or of floats."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    form, at, body = None, 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", part[:16])
            # In the extensible form the kind stands first in what follows.
            form = (int.from_bytes(part[24:26], "little") if kind == 0xFFFE and len(part) >= 26 else kind, channels, rate, bits)
        elif name == b"data":
            body = part
        at += 8 + size + size % 2
    if form is None or body is None or form[1] == 0 or form[2] == 0:
        raise ValueError("no format or no data")
    kind, channels, rate, bits = form
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels] if width else b""
    if kind == 3 and bits in (32, 64):
        x = np.nan_to_num(np.frombuffer(body, f"<f{width}").astype(np.float64)) * 32768
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) * 256
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(body, f"<i{width}").astype(np.float64) / 2.0 ** (bits - 16)
    elif kind == 1 and bits == 24:
        three = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8).astype(np.float64) / 256
    else:
        raise ValueError(f"samples of kind {kind} and {bits} bits aren't read")
    return (x.reshape(-1, channels).mean(1) if channels > 1 else x), rate


def encode_wav(samples: np.ndarray, rate: int = RATE, bits: int = 16) -> bytes:
    """A WAV file of one channel, from samples on the scale of 16 bits: of 8, 16 or 24-bit integers, or of 32-bit floats."""
    x = np.clip(samples, -32768, 32767)
    if bits == 8:
        body = (np.round(x / 256) + 128).clip(0, 255).astype(np.uint8).tobytes()
    elif bits == 24:
        body = (x * 256).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    elif bits == 32:
        body = (x / 32768).astype("<f4").tobytes()
    else:
        body = x.astype("<i2").tobytes()
    width = bits // 8
    head = struct.pack("<HHIIHH", 3 if bits == 32 else 1, 1, rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Samples at another rate, by the spectrum: what lies beyond the new rate's half is left out."""
    if rate <= 0:
        raise ValueError("a rate is positive")
    if rate == to or not len(samples):
        return samples
    n = max(round(len(samples) * to / rate), 1)
    return np.fft.irfft(np.fft.rfft(samples)[: n // 2 + 1], n) * (n / len(samples))


def melody(values: list[float], note: int = HOP) -> np.ndarray:
    """Samples that sound a vector: a note for each value, its pitch by the value's place in the vector's range."""
    x = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in values], float)
    if not len(x):
        return np.zeros(FRAME)
    low, high = x.min(), x.max()
    step = np.floor((x - low) / (high - low + 1e-12) * 24).clip(0, 24)
    hz = 220.0 * 2 ** (step / 12)
    phase = np.concatenate([[0.0], np.cumsum(np.repeat(2 * np.pi * hz / RATE, note))[:-1]])
    return 12000 * np.sin(phase)


def altered(samples: np.ndarray, seed: int, noise: float = 2000.0) -> bytes:
    """A copy of a recording, as another might have made it: cut somewhere in its first quarter, with noise, at twice the rate and in 24 bits."""
    rng = np.random.default_rng(seed)
    x = samples[rng.integers(0, max(len(samples) // 4, 1)) :]
    x = x + rng.normal(0, noise, len(x))
    return encode_wav(resampled(x, RATE, 2 * RATE), 2 * RATE, 24)


def fingerprint_audio(df: DataFrame, id_col: str = "media_id", data_col: str = "data", is_query: Column | None = None) -> DataFrame:
    """``media_id, codes, fingerprint_sha256, phases`` for every row of a column of WAV files.

    ``phases`` are, for queries, the codes from the other beginnings within a
    step. Codes are null, as are the digest and the phases, where the file is
    null, empty or can't be read. Null ids and repeated rows have a row each;
    an empty table gives an empty result; other columns are not read.
    """
    share_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            out, sha, more = [], [], []
            for data, asks in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                try:
                    x = resampled(*decode_wav(data.as_py() or b""))
                except ValueError:
                    x = None
                c = None if x is None else codes(chroma(x))
                out.append(None if c is None else c.view(np.int32))
                sha.append(None if c is None else hashlib.sha256(c.astype("<u4").tobytes()).hexdigest())
                more.append(None if c is None or not asks else [codes(chroma(x[p * HOP // PHASES :])).view(np.int32) for p in range(1, PHASES)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(sha, pa.string()), pa.array(more, pa.list_(pa.list_(pa.int32())))],
                names=["media_id", "codes", "fingerprint_sha256", "phases"],
            )

    asks = F.coalesce(is_query, F.lit(False)) if is_query is not None else F.lit(False)
    rows = df.select(F.col(id_col).alias("media_id"), F.col(data_col).alias("data"), asks.alias("asks"))
    return rows.mapInArrow(run, f"media_id {kind}, codes array<int>, fingerprint_sha256 string, phases array<array<int>>")


def bit_error(a: str, b: str, offset: str) -> Column:
    """Share of bits that differ where ``a`` begins ``offset`` positions into ``b``; 1 where they don't overlap."""
    # Counted in the low 32 bits: bit_count takes an int as a long, with its sign.
    x = F.expr(f"slice({a}, greatest(1 - {offset}, 1), greatest(least(size({a}) + least({offset}, 0), size({b}) - greatest({offset}, 0)), 0))")
    y = F.expr(f"slice({b}, greatest(1 + {offset}, 1), greatest(least(size({a}) + least({offset}, 0), size({b}) - greatest({offset}, 0)), 0))")
    wrong = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(x) > 0, wrong / (32.0 * F.size(x))).otherwise(1.0)


def _landmarks(rows: DataFrame, keep: list[str], codes_col: str) -> DataFrame:
    """``keep``, ``at`` and ``code`` where a code isn't the one before."""
    starts = F.filter(F.sequence(F.lit(0), F.size(codes_col) - 1), lambda k: _begins(codes_col, k))
    return rows.filter(F.size(codes_col) > 0).select(*keep, F.explode(starts).alias("at"), codes_col).select(*keep, "at", F.get(codes_col, F.col("at")).alias("code"))


def _begins(codes_col: str, k: Column) -> Column:
    """Whether a run of codes begins at ``k``."""
    return ~F.get(F.col(codes_col), k).eqNullSafe(F.get(F.col(codes_col), k - 1))


def votes(a: str, b: str, offset: str) -> Column:
    """At how many places a run of the same code begins in both, where ``a`` begins ``offset`` positions into ``b``."""
    first, last = F.greatest(-F.col(offset), F.lit(0)), F.least(F.size(a), F.size(b) - F.col(offset)) - 1
    both = lambda k: (F.get(a, k) == F.get(b, k + F.col(offset))) & _begins(a, k) & _begins(b, k + F.col(offset))
    return F.when(first <= last, F.size(F.filter(F.sequence(first, last), both))).otherwise(0).cast("long")


def _blocks(every: DataFrame, asked: DataFrame, classes: DataFrame, begun: DataFrame, heavy: DataFrame, most_error: float) -> DataFrame:
    """What aligns where a heavy code meets: ``q, class_id, error, offset, votes``, the best of a query and a class in a block.

    Of each code, who has it is dealt into parts of some :data:`HEAVY_CODES`
    codes, and each part of the queries is compared with each of the classes,
    in a group of its own.
    """
    spark = every.sparkSession
    heavy = F.broadcast(heavy)
    known = every.join(heavy, "code").groupBy("class_id", "code").agg(F.collect_list("at").alias("at")).join(classes.select("class_id", "codes"), "class_id")
    known = known.filter("class_id is not null")
    asked = asked.join(heavy, "code").groupBy("q", "phase", "code").agg(F.collect_list("at").alias("at")).join(begun, ["q", "phase"])
    parts = lambda rows, name: rows.groupBy("code").agg(F.ceil(F.sum(F.size("codes")) / HEAVY_CODES).cast("int").alias(name))
    parts = F.broadcast(materialize(parts(known, "known_parts").join(parts(asked, "asked_parts"), "code"), "audio-parts"))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = known.join(parts, "code").select("code", own("class_id", "known_parts").alias("known_part"), every_part("asked_parts").alias("asked_part"), "class_id", "codes", "at")
    asked = asked.join(parts, "code").select("code", every_part("known_parts").alias("known_part"), own("q", "asked_parts").alias("asked_part"), "q", "phase", "codes", "at")
    key, n = ["code", "known_part", "asked_part"], shuffle_partitions(spark)
    schema = f"q {asked.schema['q'].dataType.simpleString()}, class_id {known.schema['class_id'].dataType.simpleString()}, error double, offset double, votes long"
    # Their number is given: a block has few bytes for the time it takes, so blocks must not be put together by bytes.
    both = known.repartition(n, *key).groupBy(*key).cogroup(asked.repartition(n, *key).groupBy(*key))
    return both.applyInArrow(lambda known, asked: _compared(known, asked, most_error), schema).filter("class_id <> q")


def _matrix(codes: pa.ChunkedArray) -> np.ndarray:
    """Arrays of codes as rows, with zeros after them."""
    lists = codes.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), lengths.max(initial=0)), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    return out


def _run_starts(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones_like(codes[..., :1], bool), codes[..., 1:] != codes[..., :-1]], -1)


def _offsets(at: np.ndarray, length: int, place: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Offsets, each with the rows of which a place meets one of ``at`` there; no row twice at an offset."""
    step = max(CODES_AT_ONCE // (width + length), 1)
    for begin in range(0, n_rows, step):
        some = slice(*np.searchsorted(row, (begin, begin + step)))
        met = np.zeros((width + length, min(step, n_rows - begin)), bool)
        for k in at:
            met[place[some] - k + length, row[some] - begin] = True
        for o in np.flatnonzero(met.any(1)):
            yield int(o) - length, begin + np.flatnonzero(met[o])


def _compared(known: pa.Table, asked: pa.Table, most_error: float) -> pa.Table:
    """A block: for each query and class the best alignment, over the offsets at which one of their places ``at`` meets one of the other's."""
    known = known.take(pc.sort_indices(pc.list_value_length(known["codes"])))
    lengths = pc.list_value_length(known["codes"]).to_numpy()
    queries: dict = {}
    for k, (q, phase, codes, at) in enumerate(zip(*(asked[c].to_pylist() for c in ("q", "phase", "codes", "at")), strict=True)):
        queries.setdefault(q, (k, []))[1].append((phase, np.array(codes, np.int32).view(np.uint32), np.array(at)))
    out, begin = [], 0
    while begin < len(lengths):
        # Rows are as long as the last of them; one at least, however long it is.
        end = begin + max(int(np.searchsorted(lengths[begin:] * np.arange(1, len(lengths) - begin + 1), CODES_AT_ONCE, "right")), 1)
        some, n = known.slice(begin, end - begin), lengths[begin:end]
        rows = _matrix(some["codes"])
        begun, places = _run_starts(rows), some["at"].combine_chunks()
        place, row = places.flatten().to_numpy(), np.repeat(np.arange(len(n)), np.diff(places.offsets.to_numpy()))
        for k, beginnings in queries.values():
            best = {"error": np.full(len(n), np.inf), "far": np.zeros(len(n)), "offset": np.zeros(len(n)), "votes": np.zeros(len(n), np.int64)}
            for phase, x, at in beginnings:
                for offset, members in _offsets(at, len(x), place, row, *rows.shape):
                    _at_offset(x, offset, phase, members, rows, n, begun, most_error, best)
            hits = np.flatnonzero(best["error"] < np.inf)
            columns = [asked["q"].take(pa.array(np.full(len(hits), k))), some["class_id"].take(pa.array(hits)), *(pa.array(best[c][hits]) for c in ("error", "offset", "votes"))]
            out.append(pa.table(columns, names=["q", "class_id", "error", "offset", "votes"]))
        begin = end
    return pa.concat_tables(out) if out else pa.table({"q": asked["q"].slice(0, 0), "class_id": known["class_id"].slice(0, 0), **{c: pa.array([], t) for c, t in (("error", pa.float64()), ("offset", pa.float64()), ("votes", pa.int64()))}})


def _at_offset(x: np.ndarray, offset: int, phase: int, members: np.ndarray, rows: np.ndarray, n: np.ndarray, begun: np.ndarray, most_error: float, best: dict) -> None:
    """Keep in ``best`` what is better, of a query's codes ``x`` that begin ``offset`` positions into ``members`` of the rows."""
    low = max(offset, 0)
    overlap = np.minimum(n[members], offset + len(x)) - low
    enough = overlap >= LEAST_OVERLAP * np.minimum(len(x), n[members])
    members, overlap = members[enough], overlap[enough]
    if not len(members):
        return
    high = low + int(overlap.max())
    inside = np.arange(high - low) < overlap[:, None]
    differ = rows[members, low:high] ^ x[low - offset : high - offset]
    error, place = (np.bitwise_count(differ) * inside).sum(1, dtype=np.int64) / (32.0 * overlap), offset - phase / PHASES
    then, far = best["error"][members], abs(place)
    nearer = (far < best["far"][members]) | ((far == best["far"][members]) & (place < best["offset"][members]))
    better = (error <= most_error) & ((error < then) | ((error == then) & nearer))
    hits = members[better]
    same = (differ[better] == 0) & inside[better] & begun[hits, low:high] & _run_starts(x)[low - offset : high - offset]
    best["error"][hits], best["far"][hits], best["offset"][hits], best["votes"][hits] = error[better], far, place, same.sum(1)


def align(prints: DataFrame, is_query: Column, most_error: float = MOST_ERROR) -> DataFrame:
    """For every recording its class, and for every query what aligns with it.

    ``prints`` comes from :func:`fingerprint_audio`, with the same queries.
    Recordings of equal codes are a class (``class_id``, its smallest id).
    Returned are ``media_id, n_codes, fingerprint_sha256, class_id``, and for
    queries ``n_matches``, the other recordings that align with it, equal ones
    included, and the best of another class, ``best_class, best_offset,
    best_error, best_votes``. The offset is in steps, and says how far into the other the
    query begins. Of alignments alike in error the nearest offset is the best,
    of classes the smallest. Recordings without codes have null in them and
    match nothing; null ids are recordings, but no class's smallest.

    A histogram of offsets, over the places where a code of either beginning is
    met again, gives the candidates; every one is verified by its bits, however
    few its votes, and ``best_votes`` tells those of the best. So it is however
    many places have a code: those that very many have are compared in blocks.
    """
    known = prints.filter("codes is not null")
    classes = known.groupBy("fingerprint_sha256").agg(
        F.min("media_id").alias("class_id"), F.count("*").alias("members"), F.max(is_query.cast("int")).alias("asked"), F.min("codes").alias("codes"), F.max("phases").alias("phases")
    )
    classes = materialize(classes, "audio-classes")
    every = _landmarks(classes.select("class_id", "codes"), ["class_id"], "codes")
    begun = classes.filter("asked = 1").select(F.col("class_id").alias("q"), F.posexplode(F.concat(F.array("codes"), F.coalesce("phases", F.array().cast("array<array<int>>")))).alias("phase", "codes"))
    begun = materialize(begun, "audio-queries")
    asked = _landmarks(begun, ["q", "phase"], "codes")
    total = every.count()
    # Fewer codes than 1 / HEAVY_SHARE are heavy.
    heavy = materialize(every.groupBy("code").count().filter(F.col("count") > max(HEAVY_ROWS, int(total * HEAVY_SHARE))).select("code"), "audio-heavy")
    some_heavy = heavy.limit(1).count() > 0
    light = every.join(F.broadcast(heavy), "code", "left_anti") if some_heavy else every
    met = light.join(asked.withColumnRenamed("at", "q_at"), "code").filter("class_id <> q")
    offsets = met.select("q", "phase", "class_id", (F.col("at") - F.col("q_at")).alias("offset")).distinct()
    both = offsets.join(begun.withColumnRenamed("codes", "q_codes"), ["q", "phase"]).join(classes.select("class_id", "codes"), "class_id")
    overlap = F.least(F.size("q_codes") + F.least("offset", F.lit(0)), F.size("codes") - F.greatest("offset", F.lit(0)))
    both = both.filter(overlap >= LEAST_OVERLAP * F.least(F.size("q_codes"), F.size("codes")))
    both = both.withColumn("error", bit_error("q_codes", "codes", "offset")).filter(F.col("error") <= most_error)
    both = both.withColumn("votes", votes("q_codes", "codes", "offset")).withColumn("place", F.col("offset") - F.col("phase") / PHASES)
    both = both.select("q", "class_id", "error", F.col("place").alias("offset"), "votes")
    if some_heavy:
        both = both.unionByName(_blocks(every, asked, classes, begun, heavy, most_error))
    both = both.groupBy("q", "class_id").agg(F.min(F.struct("error", F.abs("offset").alias("far"), "offset", "votes")).alias("b")).join(classes.select("class_id", "members"), "class_id")
    both = both.select("q", "class_id", "members", F.col("b.error").alias("error"), F.col("b.offset").alias("offset"), F.col("b.votes").alias("votes"))
    found = both.groupBy("q").agg(F.sum("members").alias("others"), F.min(F.struct("error", "class_id", "offset", "votes")).alias("best"))
    named = classes.select("fingerprint_sha256", "class_id", "members").join(found, F.col("class_id") == F.col("q"), "left")
    rows = prints.join(named, "fingerprint_sha256", "left")
    asks = is_query & F.col("codes").isNotNull()
    return rows.select(
        "media_id",
        F.when(F.col("codes").isNotNull(), F.size("codes")).cast("long").alias("n_codes"),
        "fingerprint_sha256",
        "class_id",
        F.when(asks, F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_matches"),
        F.when(asks, F.col("best.class_id")).alias("best_class"),
        F.when(asks, F.col("best.offset")).alias("best_offset"),
        F.when(asks, F.col("best.error")).alias("best_error"),
        F.when(asks, F.col("best.votes")).alias("best_votes"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors sounded as recordings, and altered copies of every twentieth, all fingerprinted; each twentieth is searched for among all.

    There is no table of recordings. A copy has the id of its original below
    -1 (-2 - id); its alignment is what the query has to find.
    """
    share_package(spark)

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids, data = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = melody(v.as_py() or [])
                ids.append(i)
                data.append(encode_wav(x))
                if i is not None and i % 20 == 0:
                    ids.append(-2 - i)
                    data.append(altered(x, i))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["media_id", "data"])

    media = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("media_id"), "embedding").mapInArrow(sound, "media_id long, data binary")
    asks = (F.col("media_id") >= 0) & (F.col("media_id") % 20 == 0)
    prints = materialize(fingerprint_audio(media, is_query=asks), "audio-prints")
    return align(prints, asks).withColumnRenamed("media_id", "vec_id")
