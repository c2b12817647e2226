"""Motifs whose events are in a partial order.

Of two events that share no node, and that nothing between them connects, it is
chance which comes first. ``order_of`` keeps only the order that shared nodes
give; any other order can be passed as ``array<struct<a,b>>``, places of events
counted from 0, ``a`` before ``b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronomotif.functions.search import searcher


def order_of(events: Column) -> Column:
    """``array<struct<a,b>>``: at each node of an event, the one before it that has the node too."""

    def before(b: Column, node: Column) -> Column:
        earlier = F.slice(events, 1, b)
        places = F.filter(F.transform(earlier, lambda e, k: F.when((e["i"] == node) | (e["j"] == node), k)), lambda k: k.isNotNull())
        return F.struct(F.array_max(places).alias("a"), b.alias("b"))

    arcs = F.flatten(F.transform(events, lambda e, b: F.array(before(b, e["i"]), before(b, e["j"]))))
    return F.array_distinct(F.filter(arcs, lambda x: x["a"].isNotNull()))


def _sharer():
    """:func:`order_of` inside a task.

    A plan may leave a Python function unevaluated whose input is the result of
    a lambda, so functions that default to this order read it off the events.
    """

    def shared(events):
        last, arcs = {}, []
        for b, e in enumerate(events):
            arcs += [(last[end], b) for end in {e[0], e[1]} if end in last]
            last[e[0]] = last[e[1]] = b
        return arcs

    return shared


def _reducer():
    """A function of a number of events and arcs to the parents of each event, without those that others imply."""

    def reduced(n, order):
        after = [set() for _ in range(n)]
        for a, b in order:
            if not (0 <= a < n and 0 <= b < n):
                raise ValueError(f"no event {max(a, b)} among {n}")
            after[a].add(b)
        left = [0] * n
        for a in range(n):
            for b in after[a]:
                left[b] += 1
        ready, line = [k for k in range(n) if not left[k]], []
        while ready:
            a = ready.pop()
            line.append(a)
            for b in after[a]:
                left[b] -= 1
                if not left[b]:
                    ready.append(b)
        if len(line) < n:
            raise ValueError("the order of events has a circle")
        reached = [0] * n  # bits of all that come after
        for a in reversed(line):
            for b in after[a]:
                reached[a] |= 1 << b | reached[b]
        parents = [[] for _ in range(n)]
        for a in range(n):
            for b in after[a]:
                if not any(reached[o] >> b & 1 for o in after[a]):
                    parents[b].append(a)
        return parents

    return reduced


def _partial_key(given: bool):
    """The UDF of a key, with the order as an input or read off the events."""
    search, reduced, shared = searcher(), _reducer(), _sharer()

    def form(ntypes, events, order):
        if ntypes is None or events is None or order is None:
            return None
        v, n = len(ntypes), len(events)
        parents = reduced(n, [(x[0], x[1]) for x in order])
        colours = [(0, t) for t in ntypes] + [(1, e[2]) for e in events]
        arcs = [(e[0], v + k, "from") for k, e in enumerate(events)] + [(v + k, e[1], "to") for k, e in enumerate(events)]
        arcs += [(v + a, v + b, "before") for b in range(n) for a in parents[b]]

        def text(names):
            shades = [None] * len(colours)
            for k, name in enumerate(names):
                shades[name] = colours[k]
            return tuple(shades), tuple(sorted((names[i], names[j], label) for i, j, label in arcs))

        # Names are ranks; events are listed least name first as soon as all that come before them are.
        names = search(colours, arcs, text)[1] if colours else []
        listed, place = [], {}
        while len(listed) < n:
            k = min((k for k in range(n) if k not in place and all(a in place for a in parents[k])), key=lambda k: names[v + k])
            place[k] = len(listed)
            listed.append(k)
        at = {}
        for k in listed:
            for end in events[k][:2]:
                at.setdefault(end, len(at))
        for k in sorted(range(v), key=lambda k: names[k]):  # nodes without events
            at.setdefault(k, len(at))
        types = ",".join(str(ntypes[k]) for k in sorted(at, key=at.get))
        rows = " ".join(f"{at[events[k][0]]}>{at[events[k][1]]}:{events[k][2]}" for k in listed)
        after = " ".join(f"{a}<{b}" for a, b in sorted((place[a], place[b]) for b in range(n) for a in parents[b]))
        return f"[{types}] {rows}" + (f" | {after}" if after else "")

    if given:
        return F.udf(form, "string", useArrow=True)
    return F.udf(lambda ntypes, events: form(ntypes, events, None if events is None else shared(events)), "string", useArrow=True)


def partial_key(ntypes: Column, events: Column, order: Column | None = None) -> Column:
    """``[types] i>j:c i>j:c | 0<1``: equal for two motifs exactly where nodes, events and order are isomorphic.

    Events are listed in an order that theirs allows, nodes by first appearance;
    after the bar, which event comes before which, without what follows from
    other pairs. ``order`` is :func:`order_of` the events if it isn't given;
    circles raise. Null where any input is.
    """
    return _partial_key(False)(ntypes, events) if order is None else _partial_key(True)(ntypes, events, order)


def parse_order(key: Column) -> Column:
    """The order back from a key; node types and events come from ``canonical.parse``."""
    part = lambda k: F.regexp_extract_all(key, F.lit(r"(\d+)<(\d+)"), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b")), lambda x: F.struct(x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b")))


def _labeller():
    """A function of a number of events and their order to ``(rank, letters)`` of each."""
    reduced = _reducer()

    def labelled(n, order):
        parents = reduced(n, [(x[0], x[1]) for x in order])
        children = [[b for b in range(n) if a in parents[b]] for a in range(n)]
        roots = [k for k in range(n) if not parents[k]]
        sets = 0
        rank, letters = [1] * n, [set() for _ in range(n)]
        if len(roots) > 1:
            for k in roots:
                letters[k].add(sets)
                sets += 1
        done = set()
        while len(done) < n:
            a = min(k for k in range(n) if k not in done and all(p in done for p in parents[k]))
            done.add(a)
            for b in children[a]:
                rank[b] = max(rank[b], rank[a] + 1)
                letters[b] |= letters[a]
                if len(children[a]) > 1:
                    letters[b].add(sets)
                    sets += 1
        letter = lambda x: chr(97 + x) if x < 26 else f"({x + 1})"
        return [(rank[k], "".join(letter(x) for x in sorted(letters[k]))) for k in range(n)]

    return labelled


def _of_events(of, events: Column, order: Column | None) -> Column:
    """``of(events, order)`` as a column; the order is read off the events if it isn't given."""
    shared = _sharer()

    def both(events, order):
        return None if events is None or order is None else of(events, order)

    if order is not None:
        return F.udf(both, "array<string>", useArrow=True)(events, order)
    return F.udf(lambda events: both(events, None if events is None else shared(events)), "array<string>", useArrow=True)(events)


def order_labels(events: Column, order: Column | None = None) -> Column:
    """A label for each event: its rank, and a letter for each set of events it belongs to.

    Ranks are one more than the highest of those directly before. Where an order
    begins at several events or parts after one, each branch gets a letter of
    its own, which those after it keep; past ``z`` they are numbers in brackets.
    A single event has an empty label. ``order`` is :func:`order_of` the events
    if it isn't given. Null where an input is.
    """
    labelled = _labeller()
    return _of_events(lambda es, order: [""] if len(es) == 1 else [f"{r}{x}" for r, x in labelled(len(es), order)], events, order)


def partial_edge_labels(events: Column, order: Column | None = None) -> Column:
    """``i>j:1,2a`` for each directed edge: the labels of its events by rank; none for a single event."""
    labelled = _labeller()

    def labels(events, order):
        if len(events) == 1:
            return []
        edges = {}
        for e, label in zip(events, labelled(len(events), order)):
            edges.setdefault((e[0], e[1]), []).append(label)
        return [f"{i}>{j}:{','.join(f'{r}{x}' for r, x in sorted(ls))}" for (i, j), ls in edges.items()]

    return _of_events(labels, events, order)
