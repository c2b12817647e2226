"""N-gram Jaccard join by several global token orders (operator 3).

Tokens are word shingles. Two sets of similarity t or more share a token among
the first n - ceil(t*n) + 1 of each under any order of all tokens, so a pair
that lacks one under some order is out. Three orders are used:

1. tokens that only one document has; then by document frequency, and by a
   hash; at the end those known to be very common, rarest first;
2. and 3. after the tokens that only one document has, by two other hashes.

The first order brings candidates up. Those must share a prefix token under
the second and third too, and are then verified by their sets.

Passes: texts become sets in one pass, and their tokens go, packed, to a part of
the token space, where frequencies are counted; tokens that two documents have
come back to their documents. A document with too few of them can't have a
partner and is done. Equal sets are one class. Within the documents of a token
no list of all pairs is made: a few leaders meet all others, what links merges
into components, and buckets that still hold several components go on with more
leaders, those that had their turn gone. A pair in one component needs no test.

A token is a shingle's hash cut to 40 bits and the bits that number the parts,
45 at least: two different shingles of one pair of documents are taken for one
with a chance of about n * m / 2**45, a millionth for sets of 5,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomotif.llm.common import heavy_keys, materialize, release, share_package, shuffle_partitions, table, text_or_empty
from chronomotif.llm.components import components

WORDS = 5
PERCENT = 75
#: A sample of so many documents tells which tokens are very common: those that so many of it have; no more than so many.
#: It bears on the first order and on balance alone, not on the result.
SAMPLE_DOCS, SAMPLE_COMMON, MOST_COMMON = 4096, 32, 65_536
#: Tokens packed at once; words whose hashes a worker keeps.
FLUSH_TOKENS = 1_000_000
WORDS_KEPT = 200_000
#: Leaders of a bucket grow by this factor from round to round.
LEADER_GROWTH = 8
#: Bytes of text for a part of the token space and of the documents, and rows of a bucket that meet its leaders in one task.
PART_BYTES, MEETING_ROWS = 16 << 20, 256

_PACKED = "key int, kind int, ids binary, counts binary, a binary, b binary, c binary"
_SETS = "doc_id long, n long, class_hash binary, q int, toks array<bigint>, second array<int>, third array<int>, bits array<bigint>"
#: A set's hash and the parities of its tokens by 256 classes.
CLASSES = 256
_MARKS = np.dtype([("hash", "V16"), ("bits", "<i8", (CLASSES // 64,))])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed) * _STEP
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHashes()


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; one for a text of fewer words, none without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < words:
            out = np.uint64(n)
            for x in h:
                out = _mix(np.array([out * _STEP + x]))[0]
            return np.array([out], np.uint64)
        rolled = h[: n - words + 1].copy()
        for k in range(1, words):
            rolled = rolled * _STEP
            rolled ^= rolled >> np.uint64(32)
            rolled += h[k : n - words + 1 + k]
    return np.unique(_mix(rolled))


def _parities(tok: np.ndarray) -> bytes:
    """A bit for each class of tokens: whether the set has an odd number of them.

    Tokens that two sets share cancel, so the bits in which they differ are at
    most the tokens that they don't share.
    """
    return np.packbits((np.bincount((_mix(tok, 5) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES) & 1).astype(np.uint8)).tobytes()


def _token_shift(parts: int) -> int:
    """Bits to drop from a hash, so that tokens divided by the number of parts have 40 bits."""
    return 64 - 40 - (parts.bit_length() - 1)


def _slices(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the data between the cuts."""
    offsets = (cuts * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


def _batch(key, kind, ids, counts, a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int32()), pa.array(kind, pa.int32()), ids, counts, a, b, c], names=["key", "kind", "ids", "counts", "a", "b", "c"]
    )


def _blob(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _column(t: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in t[name]), dtype)


def _pack(batches: Iterator[pa.RecordBatch], parts: int, words: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """From ``doc_id, text``: tokens by part of the token space (kind 0), and the documents' own data (kind 1)."""
    import xxhash

    shift = np.uint64(_token_shift(parts))

    def flush() -> Iterator[pa.RecordBatch]:
        tok, doc = np.concatenate(toks), np.repeat(np.arange(len(ids)), [len(t) for t in toks])
        all_ids = np.array(ids, np.int64)
        place = np.minimum(np.searchsorted(common, tok), max(len(common) - 1, 0))
        is_common = common[place] == tok if len(common) else np.zeros(len(tok), bool)
        held = np.bincount(doc[is_common], minlength=len(ids)).astype(np.uint32)
        yield _batch(
            [int(xxhash.xxh32_intdigest(all_ids[:1].tobytes())) % parts], [1], _blob(all_ids), _blob(held), _blob(np.array(sizes, np.int64)), pa.array([b"".join(hashes)], pa.binary()), _blob(place[is_common].astype(np.int32))
        )
        tok, doc = tok[~is_common], doc[~is_common]
        part = (tok % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
        tok, doc, part = tok[order] // np.uint64(parts), doc[order], part[order]
        cuts = _runs(part)
        run = _runs(part.astype(np.int64) * len(ids) + doc)
        run_cuts = np.searchsorted(run, cuts)
        if len(part):
            keys = part[cuts[:-1]]
            yield _batch(
                keys, np.zeros(len(keys), np.int32), _slices(all_ids[doc[run[:-1]]], run_cuts), _slices(np.diff(run).astype(np.uint32), run_cuts),
                _slices(tok.astype(np.uint32), cuts), _slices((tok >> np.uint64(32)).astype(np.uint8), cuts), pa.nulls(len(keys), pa.binary()),
            )

    ids, toks, sizes, hashes, total = [], [], [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            s = shingle_set(text.as_py(), words)
            ids.append(i.as_py())
            sizes.append(len(s))
            toks.append(np.unique(s >> shift))
            hashes.append(xxhash.xxh3_128_digest(s.tobytes()) + _parities(toks[-1]))
            total += len(s)
            if total >= FLUSH_TOKENS or len(ids) >= 100_000:
                yield from flush()
                ids, toks, sizes, hashes, total = [], [], [], [], 0
    if ids:
        yield from flush()


def _group(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(ids.astype(np.uint64), 7) % np.uint64(parts)).astype(np.int32)


def _count(key: tuple, t: pa.Table, parts: int) -> pa.Table:
    """Of a part of the token space: tokens that several documents have, with their frequency, by group of documents."""
    part = key[0].as_py()
    out = []
    kinds = np.array(t["kind"])
    for row in t.filter(pa.array(kinds == 1)).to_batches():
        for k in range(row.num_rows):
            one = pa.Table.from_batches([row.slice(k, 1)])
            ids, held = _column(one, "ids", np.int64), _column(one, "counts", np.uint32).astype(np.int64)
            sizes, hashes, places = _column(one, "a", np.int64), _column(one, "b", _MARKS), _column(one, "c", np.int32)
            group = _group(ids, parts)
            order = np.argsort(group, kind="stable")
            cuts = _runs(group[order])
            starts = np.append(0, np.cumsum(held))
            where = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in order]) if len(places) else np.empty(0, np.int64)
            held_cuts = np.append(0, np.cumsum(held[order]))[cuts]
            keys = group[order][cuts[:-1]]
            out.append(_batch(keys, np.ones(len(keys), np.int32), _slices(ids[order], cuts), _slices(held[order].astype(np.uint32), cuts), _slices(sizes[order], cuts), _slices(hashes[order], cuts), _slices(places[where], held_cuts)))
    rest = t.filter(pa.array(kinds == 0))
    if rest.num_rows:
        ids = np.repeat(_column(rest, "ids", np.int64), _column(rest, "counts", np.uint32))
        tok = _column(rest, "a", np.uint32).astype(np.uint64) | (_column(rest, "b", np.uint8).astype(np.uint64) << np.uint64(32))
        order = np.argsort(tok, kind="stable")
        ids, tok = ids[order], tok[order]
        run = np.diff(_runs(tok))
        df = np.repeat(run, run)
        many = df >= 2
        ids, tok, df = ids[many], tok[many], np.minimum(df[many], 65535).astype(np.uint16)
        if len(ids):
            group = _group(ids, parts)
            order = np.lexsort((ids, group))
            ids, tok, df, group = ids[order], tok[order], df[order], group[order]
            cuts, run = _runs(group), _runs(ids)
            run = np.union1d(run, cuts)
            run_cuts = np.searchsorted(run, cuts)
            keys = group[cuts[:-1]]
            out.append(
                _batch(
                    keys, np.full(len(keys), -1 - part, np.int32), _slices(ids[run[:-1]], run_cuts), _slices(np.diff(run).astype(np.uint32), run_cuts),
                    _slices(tok.astype(np.uint32), cuts), _slices((tok >> np.uint64(32)).astype(np.uint8), cuts), _slices(df, cuts),
                )
            )
    if not out:
        return pa.Table.from_batches([], schema=pa.schema([("key", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("ids", "counts", "a", "b", "c"))]))
    return pa.Table.from_batches(out)


def _assemble(t: pa.Table, parts: int, percent: int, common: np.ndarray, ranks: np.ndarray) -> pa.Table:
    """Of a group of documents: the tokens that others have too, in the first order, where enough for a partner."""
    kinds = np.array(t["kind"])
    docs, rest = t.filter(pa.array(kinds == 1)), t.filter(pa.array(kinds < 0))
    ids, held = _column(docs, "ids", np.int64), _column(docs, "counts", np.uint32).astype(np.int64)
    sizes, hashes, places = _column(docs, "a", np.int64), _column(docs, "b", _MARKS), _column(docs, "c", np.int32)
    # An id that comes again with its text: the first stands for all.
    owner = np.repeat(np.arange(len(ids)), held)
    order = np.argsort(ids, kind="stable")
    first = np.ones(len(ids), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    kept = order[first]
    at = np.full(len(ids), -1)
    at[kept] = np.arange(len(kept))
    ids, sizes, hashes = ids[kept], sizes[kept], hashes[kept]
    doc, use = at[owner], at[owner] >= 0
    doc, places = doc[use], places[use]
    tok = [common[places].astype(np.int64)]
    rank = [ranks[places] + (1 << 32)]
    docs_of = [doc]
    if rest.num_rows:
        part = np.repeat(-1 - kinds[kinds < 0], [len(x.as_py()) // 4 for x in rest["a"]])
        own = np.repeat(_column(rest, "ids", np.int64), _column(rest, "counts", np.uint32))
        low = _column(rest, "a", np.uint32).astype(np.int64) | (_column(rest, "b", np.uint8).astype(np.int64) << 32)
        tok.append(low * parts + part)
        rank.append(_column(rest, "c", np.uint16).astype(np.int64))
        docs_of.append(np.searchsorted(ids, own))
    tok, rank, doc = np.concatenate(tok), np.concatenate(rank), np.concatenate(docs_of)
    if len(tok):
        # Of repeated rows: each token once.
        order = np.lexsort((tok, doc))
        tok, rank, doc = tok[order], rank[order], doc[order]
        fresh = np.append(True, (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1]))
        tok, rank, doc = tok[fresh], rank[fresh], doc[fresh]
    shared = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    least = (percent * sizes + 99) // 100
    q = np.where(sizes > 0, shared - least + 1, 0)  # the prefix without the tokens that no other document has
    live = q > 0
    use = live[doc]
    tok, rank, doc = tok[use], rank[use], doc[use]
    unsigned = tok.astype(np.uint64)

    def listed(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        values = pa.array(values, kind)
        gone = counts == 0
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(gone, False)), values) if len(counts) else pa.array([], pa.list_(kind))

    size = np.where(live, shared, 0)
    order = np.lexsort((_mix(unsigned, 1), rank, doc))
    bits = hashes["bits"]
    columns = [pa.array(ids), pa.array(sizes), pa.array([h.tobytes() for h in hashes["hash"]], pa.binary()), pa.array(np.maximum(q, 0), pa.int32()), listed(tok[order], size, pa.int64())]
    inside = np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(size))[:-1], size)
    for seed in (2, 3):
        order = np.lexsort((_mix(unsigned, seed), doc))
        head = order[inside < q[doc]] if len(doc) else order
        folded = (_mix(unsigned[head], 9) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        columns.append(listed(folded, np.where(live, np.maximum(q, 0), 0), pa.int32()))
    columns.append(listed(np.ascontiguousarray(bits[live]).reshape(-1), np.where(live, bits.shape[1], 0), pa.int64()))
    return pa.Table.from_arrays(columns, names=["doc_id", "n", "class_hash", "q", "toks", "second", "third", "bits"])


def common_tokens(texts: DataFrame, parts: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that are very common in a sample of documents of bounded size, and their ranks, rarest first."""
    h = F.xxhash64("doc_id")
    bound = texts.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if bound is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    shift = np.uint64(_token_shift(parts))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_set(text.as_py(), words) >> shift).astype(np.int64))], names=["tok"])

    counted = texts.filter(h <= bound).select("text").mapInArrow(tokens, "tok long").groupBy("tok").count()
    rows = counted.filter(F.col("count") >= SAMPLE_COMMON).orderBy(F.desc("count"), "tok").limit(MOST_COMMON).collect()
    tok, n = (np.array([r[c] for r in rows], np.int64) for c in ("tok", "count"))
    order = np.argsort(tok)
    tok, n = tok[order], n[order]
    ranks = np.empty(len(tok), np.int64)
    ranks[np.lexsort((tok, n))] = np.arange(len(tok))
    return tok.astype(np.uint64), ranks


def shingle_sets(texts: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """From ``doc_id, text``: by document its set's size and hash and, where it can have a partner, its shared tokens."""
    spark = texts.sparkSession
    share_package(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * shuffle_partitions(spark), 32, -(-size // PART_BYTES))
    common = common_tokens(texts, parts, words)
    sent = spark.sparkContext.broadcast(common)  # 1 MB at most
    packed = texts.mapInArrow(lambda b: _pack(b, parts, words, sent.value[0]), _PACKED)
    counted = packed.repartition(parts, "key").groupBy("key").applyInArrow(lambda key, t: _count(key, t, parts), _PACKED)
    sets = counted.repartition(parts, "key").groupBy("key").applyInArrow(lambda t: _assemble(t, parts, percent, *sent.value), _SETS)
    return materialize(sets, "sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs ``a, b``, those that pass the second and third order, and then the similarity itself."""

    def side(x: str, *cols: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))

    near = pairs.join(side("a", "second", "third"), "a").join(side("b", "second", "third"), "b")
    near = near.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
    full = near.join(side("a", "n", "toks"), "a").join(side("b", "n", "toks"), "b")
    same = F.size(F.array_intersect("toks_a", "toks_b"))
    return full.withColumn("same", same).filter(100 * F.col("same") >= percent * (F.col("n_a") + F.col("n_b") - F.col("same"))).select("a", "b")


def join_sets(sets: DataFrame, percent: int = PERCENT, every_link: bool = False) -> DataFrame:
    """From distinct sets (``set_id, n, q, toks, second, third, bits``) to ``u, v``: sets and the smallest id of their component.

    With ``every_link``, all links instead, each once, ``u`` the larger id.

    At the first token that two sets share in the first order, what can still
    follow bounds what they share in all, and so do the bits in which their
    parities differ; pairs that meet at no token where that is enough aren't
    made. The sets with the fewest tokens of their own lead first: they are the
    most like the others. The rows of a large bucket meet its leaders in
    several tasks.
    """
    spark = sets.sparkSession
    alone = F.col("n") - F.size("toks")
    words = [f"b{k}" for k in range(CLASSES // 64)]
    bucket = sets.select("set_id", "n", alone.alias("alone"), *(F.col("bits")[k].alias(b) for k, b in enumerate(words)), F.posexplode(F.slice("toks", 1, F.col("q"))).alias("at", "tok"))
    bucket = bucket.select("tok", "set_id", "n", "alone", (F.col("alone") + F.col("at") + 1).alias("place"), *words, F.col("set_id").alias("comp"))

    def several(b: DataFrame) -> DataFrame:
        """The rows of buckets that hold several components (or sets, where every link is asked for), and in how many tasks they meet."""
        c = "set_id" if every_link else "comp"
        b = b.drop("tasks")
        open_ = b.groupBy("tok").agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("rows")).filter("lo <> hi")
        open_ = materialize(open_.select("tok", "rows", F.ceil(F.col("rows") / MEETING_ROWS).cast("int").alias("tasks")), "open")
        heavy = heavy_keys(open_, "tok", "rows")
        tasks = open_.drop("rows")
        if heavy is None:
            out = b.join(tasks, "tok")
        else:
            # Large buckets keep their rows where they are.
            often = F.broadcast(tasks.join(heavy, "tok", "left_semi"))
            out = b.join(often, "tok").unionByName(b.join(heavy, "tok", "left_anti").join(tasks, "tok"))
        out = materialize(out, "buckets")
        release(open_)
        return out

    buckets = several(bucket)
    links = spark.createDataFrame([], "u long, v long")
    leaders_of, labels, every = 1, links, []
    least = F.ceil(percent * (F.col("n") + F.col("lead_n")) / F.lit(100 + percent))
    reachable = 1 + F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place"))
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"lead_{b}"))) for b in words), F.lit(0))
    new = F.lit(True) if every_link else F.col("comp") != F.col("lead_comp")
    while buckets.limit(1).count():
        turn = F.pmod(F.xxhash64("set_id"), F.lit(leaders_of))
        leader = F.min(F.struct("alone", "set_id", "n", "comp", "place", *words)).alias("x")
        leaders = buckets.groupBy("tok", turn.alias("turn")).agg(leader, F.max("tasks").alias("tasks"))
        leaders = leaders.select("tok", "tasks", *(F.col(f"x.{c}").alias(x) for c, x in (("set_id", "lead"), ("n", "lead_n"), ("comp", "lead_comp"), ("place", "lead_place"), *((b, f"lead_{b}") for b in words))))
        leaders = materialize(leaders, "leaders")
        dealt = buckets.withColumn("task", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("tasks")).cast("int")).drop("tasks")
        called = leaders.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        meets = dealt.join(called, ["tok", "task"]).filter(new & (F.col("set_id") != F.col("lead")) & (reachable >= least) & (apart <= F.col("n") + F.col("lead_n") - 2 * least))
        pairs = meets.select(F.least("set_id", "lead").alias("a"), F.greatest("set_id", "lead").alias("b")).distinct()
        found = materialize(linked(pairs, sets, percent).select(F.col("b").alias("u"), F.col("a").alias("v")), "found")
        led = leaders.select(F.col("tok").alias("of"), "lead")
        left = buckets.join(led, (F.col("tok") == F.col("of")) & (F.col("set_id") == F.col("lead")), "left_anti")
        before = [buckets, leaders]
        if every_link:
            every.append(found)
            left = materialize(left, "left")
        else:
            joined = components(labels.unionAll(found))
            left = materialize(left.drop("comp").join(joined, F.col("set_id") == F.col("u"), "left").select(*(c for c in bucket.columns if c != "comp"), F.coalesce("v", "set_id").alias("comp")), "left")
            before += [found, labels]
            labels = joined
        buckets = several(left)
        release(*before, left)
        leaders_of *= LEADER_GROWTH
    release(buckets)
    for f in every:
        links = links.unionAll(f)
    return links.distinct() if every_link else labels


def _classes(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows; by document its set's size, hash and tokens; and the distinct sets, each by the smallest id that has it."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    named = rows.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        named = named.groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = shingle_sets(named, words, percent)
    live = sets.filter("toks is not null")
    classes = live.groupBy("class_hash").agg(F.min("doc_id").alias("set_id"))
    distinct = live.join(classes.select("set_id"), F.col("doc_id") == F.col("set_id")).select("class_hash", "set_id", "n", "q", "toks", "second", "third", "bits")
    return rows, sets, materialize(distinct, "distinct-sets")


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Links are between texts whose shingle sets have a Jaccard similarity of
    ``percent`` or more; a component's id is the smallest integer id in it. A
    null or empty text has no shingles and no links. Rows that repeat an id
    are one document, the smallest text standing for it. Rows with a null id
    are returned with null in the other columns. An empty table gives an empty
    result; other columns are not read.
    """
    rows, sets, distinct = _classes(df, id_col, text_col, words, percent)
    labels = join_sets(distinct, percent)
    named = distinct.select("class_hash", "set_id").join(labels, F.col("set_id") == F.col("u"), "left").select("class_hash", F.coalesce("v", "set_id").alias("component_id"))
    live = sets.filter("toks is not null")
    # Documents without a class of their own here are alone.
    alone = sets.filter("toks is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    # Copies of one text may be very many: their class is sent to every task.
    sizes = live.groupBy("class_hash").agg(F.count("*").alias("rows"))
    heavy = heavy_keys(sizes, "class_hash", "rows")
    small = live.select("doc_id", F.col("n").alias("n_shingles"), "class_hash")
    if heavy is None:
        together = small.join(named, "class_hash")
    else:
        often = F.broadcast(named.join(heavy, "class_hash", "left_semi"))
        together = small.join(often, "class_hash").unionByName(small.join(heavy, "class_hash", "left_anti").join(named, "class_hash"))
    nameless = rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return together.drop("class_hash").unionByName(alone).unionByName(nameless)


def ngram_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link: ``doc_id, class_id`` for each document with words, and ``a, b``, the classes that are linked, ``a`` the smaller.

    A class is the documents of one shingle set, its id the smallest of
    theirs; documents of a class are all linked with one another, and with
    all those of linked classes. Rows as for :func:`ngram_components`; those
    with null ids are left out.
    """
    _, sets, distinct = _classes(df, id_col, text_col, words, percent)
    links = join_sets(distinct, percent, every_link=True)
    members = sets.filter("toks is not null").select("doc_id", "class_hash").join(distinct.select("class_hash", F.col("set_id").alias("class_id")), "class_hash")
    alone = sets.filter("toks is null and n > 0").select("doc_id", F.col("doc_id").alias("class_id"))
    return members.select("doc_id", "class_id").unionByName(alone), links.select(F.col("v").alias("a"), F.col("u").alias("b"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


#: The same components for DuckDB, by all pairs that share a shingle: for small tables.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))
 WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
u AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
c(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, c.c FROM c JOIN u ON u.a = c.id WHERE c.c < u.b)
SELECT doc_id, n AS n_shingles, m AS component_id FROM n JOIN (SELECT id, min(c) AS m FROM c GROUP BY id) ON id = doc_id"""
