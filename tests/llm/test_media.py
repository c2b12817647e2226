import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomotif.llm import media


def tune(seed, n=60):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.integers(0, 24, n), 4)[:n].tolist()


def test_shifted_recordings_align(spark):
    base = media.melody(tune(1))
    noise = np.random.default_rng(0).normal(0, 60, len(base))
    rows = [
        (0, media.encode_wav(base)), (1, media.encode_wav(base + noise)), (2, media.encode_wav(base[5 * media.HOP :])), (3, media.encode_wav(media.melody(tune(2)))), (4, media.encode_wav(base)),
        (5, None), (6, b"junk"), (7, b""), (8, media.encode_wav(np.zeros(50))), (9, b"RIFF\0\0\0\0WAVEfmt "), (None, media.encode_wav(base)), (None, None),
    ]
    df = spark.createDataFrame(rows, "media_id long, data binary").withColumn("codes", F.lit(1)).withColumn("class_id", F.lit("x"))
    asks = F.col("media_id").isin(0, 2, 5)
    out = media.align(media.fingerprint_audio(df, is_query=asks), asks).collect()
    assert len(out) == len(rows)
    out = {r["media_id"]: r for r in out if r["media_id"] is not None or r["n_codes"]}
    assert out[4]["class_id"] == 0 == out[None]["class_id"] and out[0]["n_matches"] == 4
    assert out[0]["best_class"] in (1, 2) and out[0]["best_error"] < 0.1
    assert out[2]["best_class"] == 0 and out[2]["best_offset"] == 5
    assert out[5]["n_codes"] is None and out[6]["n_codes"] is None and out[7]["class_id"] is None and out[9]["n_codes"] is None
    assert out[3]["n_matches"] is None and out[8]["n_codes"] == 1


def test_integral_image_matches_plain_sums():
    frames = np.random.default_rng(2).random((20, 12))
    got = media.codes(frames)
    assert len(got) == 20 - media.SPAN + 1
    for t in range(len(got)):
        bits = 0
        for kind, low, tall, wide in media._filters():
            high, half, mid = min(low + tall, 12), wide // 2, low + max(tall // 2, 1)
            x = frames[t : t + media.SPAN]
            if kind == 0:
                a, b = x[:half, low:high].sum(), x[half:wide, low:high].sum()
            elif kind == 1:
                a, b = x[:wide, low:mid].sum(), x[:wide, mid:high].sum()
            elif kind == 2:
                a, b = x[:half, low:mid].sum() + x[half:wide, mid:high].sum(), x[:half, mid:high].sum() + x[half:wide, low:mid].sum()
            else:
                a = x[:wide, low:high].sum()
                b = (x[:wide].sum() - a) * (high - low) / (12 - high + low)
            n = sum(np.log((a + 0.05) / (b + 0.05)) >= c for c in media.CUTS)
            bits = bits << 2 | (0, 1, 3, 2)[n]
        assert int(got[t]) == bits


def test_empty(spark):
    df = spark.createDataFrame([], "media_id long, data binary")
    assert media.align(media.fingerprint_audio(df), F.col("media_id") == 0).count() == 0


def brute(queries, known):
    """All alignments of a query's beginnings with every recording, over all offsets."""
    out = set()
    for q, phases in queries.items():
        for i, c in known.items():
            if i == q:
                continue
            for x in phases:
                for o in range(-len(x) + 1, len(c)):
                    a, b = x[max(0, -o) :], c[max(0, o) :]
                    n = min(len(a), len(b))
                    if n >= media.LEAST_OVERLAP * min(len(x), len(c)) and np.unpackbits((a[:n] ^ b[:n]).view(np.uint8)).mean() <= media.MOST_ERROR:
                        out.add((q, i))
    return out


@pytest.mark.parametrize("heavy_rows", [media.HEAVY_ROWS, 12])
def test_recall_against_brute_force(spark, monkeypatch, heavy_rows):
    """Copies cut, noisy, at other rates and depths: at least nine in ten of what all offsets of all pairs show is found, and nothing else.

    So it is where codes of more than twelve landmarks are heavy, and looked up with those after them.
    """
    monkeypatch.setattr(media, "HEAVY_ROWS", heavy_rows)
    rng = np.random.default_rng(7)
    rows, sounds = [], {}
    for k in range(40):
        x = media.melody(rng.integers(0, 25, 64).tolist())
        for j, y in enumerate((x, x[rng.integers(0, 4000) :], (x + rng.normal(0, 4000, len(x)))[rng.integers(0, 3000) :], x[rng.integers(0, 3000) :][:9000])):
            rate = (4000, 4000, 8000, 11025)[(j + k) % 4]
            data = media.encode_wav(media.resampled(y, 4000, rate), rate, (16, 8, 24, 32)[j])
            sounds[4 * k + j] = data
            rows.append((4 * k + j, data))
    asks = F.col("media_id") % 4 == 0
    prints = media.fingerprint_audio(spark.createDataFrame(rows, "media_id long, data binary"), is_query=asks)
    got = {r["media_id"]: r["n_matches"] for r in media.align(prints, asks).filter(asks).collect()}
    known, queries = {}, {}
    for i, data in sounds.items():
        x = media.resampled(*media.decode_wav(data))
        known[i] = media.codes(media.chroma(x))
        if i % 4 == 0:
            queries[i] = [media.codes(media.chroma(x[p * media.HOP // media.PHASES :])) for p in range(media.PHASES)]
    want = brute(queries, known)
    assert len(want) >= 100 and all(got[q] <= sum(a == q for a, _ in want) for q in got)
    assert sum(got.values()) >= 0.9 * len(want)


def test_heavy_codes_are_split(spark, monkeypatch):
    """A code that begins every recording is looked up with those after it; held notes are one landmark."""
    monkeypatch.setattr(media, "HEAVY_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        c = np.concatenate([np.full(20, 7), rng.integers(0, 2**31, 30)]).astype(np.int32)
        near = c.copy()
        near[25] ^= 3
        rows += [(2 * k, c.tolist(), f"a{k}", None), (2 * k + 1, near[5:].tolist(), f"b{k}", None)]
    rows += [(100, [7] * 9, "c", None), (101, [7] * 10, "d", None)]
    prints = spark.createDataFrame(rows, "media_id long, codes array<int>, fingerprint_sha256 string, phases array<array<int>>")
    out = {r["media_id"]: r for r in media.align(prints, F.col("media_id") % 2 == 0).collect()}
    for k in range(12):
        assert out[2 * k]["best_class"] == 2 * k + 1 and out[2 * k]["best_offset"] == -5 and out[2 * k]["n_matches"] == 1
        assert out[2 * k]["best_votes"] == 29  # of 30 codes beyond the held note, one differs
    assert out[100]["best_class"] == 101 and out[100]["best_error"] == 0


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_other_rates_and_depths(spark, bits):
    x = media.melody(tune(3))
    got, rate = media.decode_wav(media.encode_wav(x, 4000, bits))
    assert rate == 4000 and np.abs(got - x).max() <= (129 if bits == 8 else 1)
    df = spark.createDataFrame([(0, media.encode_wav(x)), (1, media.encode_wav(media.resampled(x, 4000, 8000), 8000, bits))], "media_id long, data binary")
    out = {r["media_id"]: r for r in media.align(media.fingerprint_audio(df, is_query=F.col("media_id") == 0), F.col("media_id") == 0).collect()}
    assert out[0]["n_codes"] == out[1]["n_codes"] and out[0]["n_matches"] == 1


def test_two_channels_and_other_kinds():
    x = (1000 * np.sin(np.arange(2000))).astype(np.int16)
    mono = media.encode_wav(x)
    both = np.repeat(x, 2)
    stereo = mono[:22] + (2).to_bytes(2, "little") + mono[24:40] + (4 * len(x)).to_bytes(4, "little") + both.tobytes()
    assert (media.decode_wav(stereo)[0] == x).all()
    with pytest.raises(ValueError):
        media.decode_wav(mono[:20] + (7).to_bytes(2, "little") + mono[22:])


def test_query_finds_its_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(100)] + [(200, None), (220, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {r["vec_id"]: r for r in media.op9_media(spark, str(tmp_path)).collect()}
    assert len(out) == 102 + 7
    for k in range(0, 100, 20):
        assert out[k]["best_class"] == -2 - k and out[k]["n_matches"] == 1 and out[k]["best_error"] < media.MOST_ERROR
    x = media.codes(media.chroma(media.resampled(*media.decode_wav(media.encode_wav(media.melody(np.float32(rows[7][1]).tolist()))))))
    assert out[7]["fingerprint_sha256"] == hashlib.sha256(x.astype("<u4").tobytes()).hexdigest()


def test_heavy_codes_lose_nothing(spark, monkeypatch):
    """Recordings that share a single code, among many that have it: the same rows whether none, some or all codes are heavy, and all of the alignments where landmarks meet."""
    rng = np.random.default_rng(9)
    rows, known = [], {}
    for k in range(20):
        c = rng.integers(-(2**31), 2**31, int(rng.integers(20, 60))).astype(np.int32)
        c[k % 5] = 7
        if k % 3 == 0:  # a code again and again, and held
            c[8:20:3] = 7
            c[14:17] = 7
        known[10 * k] = c
        for j in range(1, 3):  # no code but the heavy one is the same
            near = c ^ (1 << rng.integers(0, 32, len(c))).astype(np.int64).astype(np.int32)
            near[c == 7] = 7
            known[10 * k + j] = near[rng.integers(0, k % 5 + 1) :] if j == 2 else near
    rows = [(i, c.tolist(), hashlib.sha256(c.tobytes()).hexdigest(), [c[1:].tolist()] if i % 20 == 0 else None) for i, c in known.items()]
    prints = spark.createDataFrame(rows, "media_id long, codes array<int>, fingerprint_sha256 string, phases array<array<int>>")
    asks = F.col("media_id") % 20 == 0

    def starts(c):
        return np.concatenate([[True], c[1:] != c[:-1]])

    want = {}
    for q in (i for i in known if i % 20 == 0):
        for i, c in known.items():
            for phase, x in enumerate((known[q], known[q][1:])) if i != q else ():
                for o in range(-len(x) + 1, len(c)):
                    a, b = slice(max(0, -o), min(len(x), len(c) - o)), slice(max(0, o), min(len(c), len(x) + o))
                    n, votes = b.stop - b.start, int(((x[a] == c[b]) & starts(x)[a] & starts(c)[b]).sum())
                    wrong = np.unpackbits((x[a] ^ c[b]).view(np.uint8)).mean() if n else 1
                    if votes and n >= media.LEAST_OVERLAP * min(len(x), len(c)) and wrong <= media.MOST_ERROR:
                        place = o - phase / media.PHASES
                        want[q, i] = min(want.get((q, i), (1,)), (wrong, abs(place), place, votes))
    assert len(want) >= 20
    # So many blocks a code, and so few codes at once, that each is used.
    monkeypatch.setattr(media, "HEAVY_CODES", 500, raising=False)
    monkeypatch.setattr(media, "CODES_AT_ONCE", 300, raising=False)
    for heavy_rows in (1000, 10, 0):
        monkeypatch.setattr(media, "HEAVY_ROWS", heavy_rows)
        out = {r["media_id"]: r for r in media.align(prints, asks).collect()}
        for q in (i for i in known if i % 20 == 0):
            mine = {i: w for (a, i), w in want.items() if a == q}
            assert out[q]["n_matches"] == len(mine)
            if mine:
                best = min(mine, key=lambda i: (mine[i][0], i))
                error, _, place, votes = mine[best]
                assert (out[q]["best_class"], out[q]["best_offset"], out[q]["best_error"], out[q]["best_votes"]) == (best, place, error, votes)
