"""Randomised events and networks: what a null hypothesis leaves as it is."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomotif.functions.numbering import numbered
from chronomotif.operators.nullmodel import uniform
from chronomotif.storage import released, saved

#: Accepted swaps for each event.
SWAPS = 10
#: Tries for each of them, beyond which a shuffle is given up, aloud.
MOST_TRIES = 100


def permuted(df: DataFrame, key: list[str], value: list[str], seed: int, within: list[str] | None = None) -> DataFrame:
    """``df`` with the ``value`` columns permuted over its rows, within groups if given.

    Both sides are numbered, one by its key and one by a hash, and joined at
    the numbers; without groups the numbering is a global order, made by ranges.
    """
    within = within or []
    rank = df.withColumn("_u", uniform(seed, *(F.col(c) for c in key)))
    left = numbered(df.drop(*value), [*within, *key], "_n")
    right = numbered(rank.select(*within, "_u", *key, *value), [*within, "_u", *key], "_n").select("_n", *value)
    # Groups take the same stretch of numbers on both sides.
    return left.join(right, "_n").select(df.columns)


def shuffle_node_types(node_types: DataFrame, seed: int) -> DataFrame:
    """Types permuted over all nodes."""
    return permuted(node_types, ["node"], ["ntype"], seed)


def shuffle_edge_types(events: DataFrame, seed: int) -> DataFrame:
    """Types permuted over directed edges; raises where an edge has more than one type."""
    edges = events.groupBy("src", "dst").agg(F.min("etype").alias("etype"), F.max("etype").alias("most"))
    if edges.filter("etype <> most").limit(1).count():
        raise ValueError("an edge has events of several types")
    new = permuted(edges.drop("most"), ["src", "dst"], ["etype"], seed)
    return events.drop("etype").join(new, ["src", "dst"]).select(events.columns)


def shuffle_event_types(events: DataFrame, seed: int) -> DataFrame:
    """Types permuted over events."""
    return permuted(events, ["event_id"], ["etype"], seed)


def shuffle_times(events: DataFrame, seed: int) -> DataFrame:
    """Times permuted over events of a type, whether or not events then overlap; ids follow the new times."""
    mixed = permuted(events, ["event_id"], ["start", "end"], seed, ["etype"])
    return renumbered(mixed)


def renumbered(events: DataFrame) -> DataFrame:
    """Ids 0, 1, ... by start and old id."""
    rows = numbered(events.withColumnRenamed("event_id", "_old"), ["start", "_old"], "event_id")
    return rows.select(events.columns)


def overlapping(events: DataFrame) -> DataFrame:
    """``node, a, b``: events of a node of which the second starts no later than the first ends."""
    from chronomotif.operators.adjacency import node_events

    w = Window.partitionBy("node").orderBy("start", "event_id")
    rows = node_events(events).select("node", F.col("event_id").alias("a"), "end", F.lead("event_id").over(w).alias("b"), F.lead("start").over(w).alias("b_start"))
    return rows.filter("b is not null and end >= b_start").select("node", "a", "b")


def faults(events: DataFrame) -> DataFrame:
    """``event_id, fault`` for rows that break the rules of an event table: loops, ends before starts, ids out of order, repeated ids."""
    w = Window.partitionBy("event_id")
    rows = events.withColumn("n", F.count("*").over(w))
    faults_ = F.array_compact(
        F.array(F.when(F.col("src") == F.col("dst"), "loop"), F.when(F.col("end") < F.col("start"), "ends before it starts"), F.when(F.col("n") > 1, "repeated id"))
    )
    single = rows.select("event_id", F.explode(faults_).alias("fault"))
    # Each event and the one before it, by their places in the order of ids.
    placed = numbered(events.select("event_id", "start"), ["event_id", "start"], "_n")
    before = placed.select((F.col("_n") + 1).alias("_n"), F.col("start").alias("before"))
    late = placed.join(before, "_n").filter("before > start").select("event_id", F.lit("out of order").alias("fault"))
    return single.unionByName(late)


class _Timeline:
    """Which events a node has at which times, in order of their starts, for swaps that must not make them overlap."""

    def __init__(self, e: pd.DataFrame, around: Callable[[object, int], tuple[float, float]] | None = None):
        self.start, self.end = e["start"].tolist(), e["end"].tolist()
        self.src, self.dst = e["src"].tolist(), e["dst"].tolist()
        self.longest = int((e["end"] - e["start"]).max()) if len(e) else 0
        #: Where a node's events before and after the time's window end and begin, if they are with another task.
        self.around = around or (lambda node, start: (-math.inf, math.inf))
        self.at: dict[object, list[tuple[int, int]]] = {}
        for k in np.argsort(e["start"].to_numpy(), kind="stable").tolist():
            for node in {self.src[k], self.dst[k]}:
                self.at.setdefault(node, []).append((self.start[k], k))

    def fits(self, k: int, start: int, end: int, but: int) -> bool:
        """Whether event ``k`` could have these times, events ``k`` and ``but`` aside: only those that start near can overlap."""
        for node in (self.src[k], self.dst[k]):
            rows = self.at[node]
            for i in range(bisect_left(rows, (start - self.longest, -1)), len(rows)):
                at, x = rows[i]
                if at > end:
                    break
                if x != k and x != but and self.end[x] >= start:
                    return False
        return True

    def _moved(self, k: int, start: int, end: int) -> None:
        for node in {self.src[k], self.dst[k]}:
            rows = self.at[node]
            del rows[bisect_left(rows, (self.start[k], k))]
            insort(rows, (start, k))
        self.start[k], self.end[k] = start, end

    def swap(self, a: int, b: int) -> bool:
        """Exchange the times of two events, if neither then overlaps another at its nodes."""
        sa, ea, sb, eb = self.start[a], self.end[a], self.start[b], self.end[b]
        if sa <= eb and sb <= ea and {self.src[a], self.dst[a]} & {self.src[b], self.dst[b]}:
            return False
        if not (self.fits(a, sb, eb, b) and self.fits(b, sa, ea, a)):
            return False
        self._moved(a, sb, eb)
        self._moved(b, sa, ea)
        return True

    def closeness(self, a: int, b: int) -> float:
        """Mean logarithm of the gaps to the events before and after, at both nodes of ``a``, if it had the times of ``b``; infinite where they overlap."""
        start, end, gaps = self.start[b], self.end[b], []
        for node in (self.src[a], self.dst[a]):
            rows = self.at[node]
            i = j = bisect_left(rows, (start, -1))
            while i and rows[i - 1][1] in (a, b):
                i -= 1
            while j < len(rows) and rows[j][1] in (a, b):
                j += 1
            before, after = self.around(node, start)
            if i:
                before = max(before, self.end[rows[i - 1][1]])
            if j < len(rows):
                after = min(after, rows[j][0])
            for gap in (start - before, after - end):
                if gap <= 0:
                    return math.inf
                if gap < math.inf:
                    gaps.append(math.log(gap))
        return sum(gaps) / len(gaps) if gaps else -math.inf


def _exchanges(e: pd.DataFrame, line: _Timeline, candidates: int, rng: np.random.Generator, asked: int) -> None:
    """So many accepted exchanges on a timeline, between movable events of a type."""
    moves, etype = e["_moves"].to_numpy(), e["etype"].to_numpy()
    peers = [p.tolist() for t in np.unique(etype) if len(p := np.flatnonzero(moves & (etype == t))) > 1]
    if not peers:
        return
    of = [p for p in peers for _ in p]
    movable = [a for p in peers for a in p]
    done = tried = 0
    while done < asked:
        for pick in rng.random((1_024, candidates + 1)).tolist():
            if done == asked:
                break
            if tried >= MOST_TRIES * asked:
                raise ValueError(f"of {tried} exchanges tried only {done} leave no overlap, {asked} are asked for")
            tried += 1
            at = int(pick[0] * len(movable))
            a, mates = movable[at], of[at]
            others = [b for u in pick[1:] if (b := mates[int(u * len(mates))]) != a]
            if candidates > 1:
                others.sort(key=lambda b: line.closeness(a, b))  # noqa: B023
            done += any(line.swap(a, b) for b in others)


#: Events that one task shuffles, about; windows of time for each such group; rounds in which groups are dealt anew.
GROUP_EVENTS, WINDOWS, ROUNDS = 25_000, 4, 5


def _exchanged(events: DataFrame, candidates: int, seed: int) -> DataFrame:
    """Events after ``SWAPS`` accepted exchanges of times for each, with ids that follow the new times.

    Time is cut into windows, and windows are dealt to groups at random, anew in
    each round. Events that lie within the windows of a group exchange their
    times there, in a chain. Whatever they could overlap meets these windows
    too: events across a border are known on either side, and stay for the round.
    Windows are sixteen times as long as the longest event, at least; where that
    leaves one, all is one chain.
    """
    events = saved(events, "shuffling")
    n, lo, hi, longest = events.agg(F.count("*"), F.min("start"), F.max("end"), F.max(F.col("end") - F.col("start"))).first()
    if not n:
        return events
    groups = -(-n // GROUP_EVENTS)
    width = max(16 * (longest + 1), -(-(hi - lo + 1) // (groups * WINDOWS)))
    groups = min(groups, ((hi - lo) // width + 2) // 2)
    width, rounds = (width, ROUNDS) if groups > 1 else (hi - lo + 1, 1)
    for r in range(rounds):
        rng = np.random.default_rng([seed, r])
        offset = int(rng.integers(0, width)) if groups > 1 else 0
        dealt = (rng.permutation((hi - lo) // width + (2 if groups > 1 else 1)) % groups).tolist()
        table = events.sparkSession.createDataFrame(list(enumerate(dealt)), "_w int, _g int")  # a row for each window, of which there are few
        window = lambda c: F.floor((F.col(c) - lo + offset) / width).cast("int")  # noqa: E731, B023
        placed = events.withColumns({"_from": window("start"), "_to": window("end")})
        met = placed.withColumn("_w", F.explode(F.sequence("_from", "_to"))).join(F.broadcast(table), "_w")
        met = met.select(*events.columns, (F.col("_from") == F.col("_to")).alias("_moves"), (F.col("_w") == F.col("_from")).alias("_own"), "_g")

        alone, beside = _chained(seed, r, rounds, candidates, events.columns, lambda start, at=offset, w=width: (start - lo + at) // w)
        if candidates > 1 and groups > 1:
            near = saved(_around(placed, met, table), "around").repartition(4 * groups, "_g")
            new = met.repartition(4 * groups, "_g").groupBy("_g").cogroup(near.groupBy("_g")).applyInPandas(beside, events.schema)
        else:
            new = met.repartition(4 * groups, "_g").groupBy("_g").applyInPandas(alone, events.schema)  # a number, or groups would be put into one task
        before, events = events, saved(new, "shuffling")
        released(before)
    return renumbered(events)


def _chained(seed: int, r: int, rounds: int, candidates: int, columns: list[str], window: Callable[[int], int]) -> tuple[Callable, Callable]:
    """A group's chain of one round: over its events alone, or with those of :func:`_around` beside them."""

    def chain(e: pd.DataFrame, around: Callable | None) -> pd.DataFrame:
        # An event across a border between two of the group's windows is there twice.
        own, other = e[e["_own"]], e[~e["_own"]].drop_duplicates(columns)
        other = other[~other["event_id"].isin(own["event_id"])]
        e = pd.concat([own, other]).sort_values(["event_id", *columns], kind="stable").reset_index(drop=True)
        line = _Timeline(e, around)
        if len(own):
            _exchanges(e, line, candidates, np.random.default_rng([seed, r, int(e["_g"][0])]), -(-SWAPS * len(own) // rounds))
        e["start"], e["end"] = line.start, line.end
        return e.loc[e["_own"], columns]

    def alone(e: pd.DataFrame) -> pd.DataFrame:
        return chain(e, None)

    def beside(e: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        numbers = lambda values, none: [none if v is None or v != v else int(v) for v in values]
        known = {}
        for node, ws, before, after in zip(c["node"], c["ws"], c["before"], c["after"], strict=True):
            known |= {(node, int(w)): x for w, x in zip(ws, zip(numbers(before, -math.inf), numbers(after, math.inf), strict=True), strict=True)}
        nowhere = (-math.inf, math.inf)
        return chain(e, lambda node, start: known.get((node, window(start)), nowhere))

    return alone, beside


def _around(placed: DataFrame, met: DataFrame, table: DataFrame) -> DataFrame:
    """``_g, node, ws, before, after``: for each node of a group and each of the group's windows, the last end before it and the first start after it.

    As they are when the round begins. A node's windows are few, so they are held as arrays.
    """
    ends = placed.select(F.explode(F.array("src", "dst")).alias("node"), "_from", "_to", "start", "end")
    last = ends.groupBy("node", F.col("_to").alias("w")).agg(F.max("end").alias("v")).groupBy("node").agg(F.collect_list(F.struct("w", "v")).alias("lasts"))
    first = ends.groupBy("node", F.col("_from").alias("w")).agg(F.min("start").alias("v")).groupBy("node").agg(F.collect_list(F.struct("w", "v")).alias("firsts"))
    own = table.groupBy("_g").agg(F.collect_list("_w").alias("ws"))
    rows = met.select("_g", F.explode(F.array("src", "dst")).alias("node")).distinct().join(last, "node").join(first, "node").join(F.broadcast(own), "_g")
    before = F.transform("ws", lambda w: F.array_max(F.transform(F.filter("lasts", lambda x: x["w"] < w), lambda x: x["v"])))
    after = F.transform("ws", lambda w: F.array_min(F.transform(F.filter("firsts", lambda x: x["w"] > w), lambda x: x["v"])))
    return rows.select("_g", "node", "ws", before.alias("before"), after.alias("after"))


def constrained_time_shuffle(events: DataFrame, seed: int) -> DataFrame:
    """Times exchanged between events of a type, never so that events overlap at a node: see :func:`_exchanged`."""
    return _exchanged(events, 1, seed)


def biased_time_shuffle(events: DataFrame, candidates: int, seed: int) -> DataFrame:
    """As the constrained one, but of several partners the one is taken whose time lies closest to the events before and after at the event's nodes.

    Of events outside a group's windows it is known where they were when the round began.
    """
    return _exchanged(events, candidates, seed)


def shuffled(events: DataFrame, node_types: DataFrame | None, kind: int, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Shuffle by number: 0 types (of nodes if there are any, else of edges), 1 constrained times, more biased with so many candidates."""
    if kind == 0:
        return (events, shuffle_node_types(node_types, seed)) if node_types is not None else (shuffle_edge_types(events, seed), None)
    return (constrained_time_shuffle(events, seed) if kind == 1 else biased_time_shuffle(events, kind, seed)), node_types


#: Edges that one task rewires, about: more are parted into blocks by colours of their ends.
BLOCK_EDGES = 2**17


def configuration_model(edges: DataFrame, seed: int, rounds: int = 10) -> DataFrame:
    """An undirected network (``u, v, w``) rewired at random with every node's degree kept, without loops or double edges.

    A round tries as many exchanges as there are edges. Nodes get colours, new
    ones each round, and edges whose ends have the same two colours are a block:
    an exchange of ends of one colour between two of them gives edges of the
    block again, so whether these are there already is known there, and blocks
    are rewired beside each other. In a block it is a chain of exchanges.
    """
    edges = saved(edges, "rewiring")
    colours = max(1, math.ceil(math.sqrt(2 * edges.count() / BLOCK_EDGES)))
    for r in range(rounds if colours > 1 else 1):
        colour = lambda c, r=r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), c), F.lit(colours)).cast("int")
        turned = colour("u") > colour("v")
        block = edges.select("*", F.least(colour("u"), colour("v")).alias("_a"), F.greatest(colour("u"), colour("v")).alias("_b"), turned.alias("_turned"))
        rewire = _rewiring(seed, r, 1 if colours > 1 else rounds, edges.columns)
        before, edges = edges, saved(block.groupBy("_a", "_b").applyInPandas(rewire, edges.schema), "rewiring")
        released(before)
    return edges


def _rewiring(seed: int, r: int, tries: int, columns: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values(["u", "v"], kind="stable").reset_index(drop=True)
        n, one = len(e), bool(e["_a"][0] == e["_b"][0])
        rng = np.random.default_rng([seed, r, int(e["_a"][0]), int(e["_b"][0])])
        nodes, at = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]), return_inverse=True)
        turned, m = e["_turned"].to_numpy(), len(nodes)
        # Ends of the lesser colour first; in a block of one colour any end may be.
        x, y = np.where(turned, at[n:], at[:n]).tolist(), np.where(turned, at[:n], at[n:]).tolist()
        key = (lambda i, j: i * m + j if i < j else j * m + i) if one else (lambda i, j: i * m + j)
        have = {key(i, j) for i, j in zip(x, y, strict=True)}
        left = tries * n if n > 1 else 0
        while left:
            size = min(left, 2**16)
            left -= size
            first, second = rng.integers(0, n, size), rng.integers(0, n - 1, size)
            for a, b, turn in zip(first.tolist(), (second + (second >= first)).tolist(), (rng.random(size) < 0.5).tolist(), strict=True):
                p, q = (y[b], x[b]) if one and turn else (x[b], y[b])
                u, v = x[a], y[a]
                if u == q or p == v:
                    continue
                new, other = key(u, q), key(p, v)
                if new == other or new in have or other in have:
                    continue
                have.remove(key(u, v))
                have.remove(key(p, q))
                have.add(new)
                have.add(other)
                y[a], x[b], y[b] = q, p, v
        e["u"], e["v"] = nodes[np.minimum(x, y)], nodes[np.maximum(x, y)]
        return e[columns]

    return run
