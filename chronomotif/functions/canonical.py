"""Canonical forms of motifs as column expressions.

Events are in a total order, which fixes which event is which; nodes named by
their first appearance then make the form canonical without any search. Forms
that forget the order take the least one over all permutations of the nodes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronomotif.functions.partial import partial_key
from chronomotif.functions.search import searcher
from chronomotif.operators.subgraphs import nodes_of

#: Nodes up to which permutations are tried, in expressions; larger motifs are searched by :func:`_searched`, as five nodes took eight seconds of planning a form.
MOST_NODES = 3


def relabelled(edges: str = "edges") -> Column:
    """``array<struct<i,j,c>>``: ends by first appearance, and the event's type."""
    place = lambda n: (F.array_position(nodes_of(edges), n) - 1).cast("int")
    return F.transform(edges, lambda e: F.struct(place(e["src"]).alias("i"), place(e["dst"]).alias("j"), e["etype"].alias("c")))


def key(ntypes: Column, events: Column) -> Column:
    """``[types] i>j:c i>j:c``, the whole form as text."""
    one = lambda e: F.concat(e["i"].cast("string"), F.lit(">"), e["j"].cast("string"), F.lit(":"), e["c"].cast("string"))
    types = F.array_join(F.transform(ntypes, lambda t: t.cast("string")), ",")
    return F.concat(F.lit("["), types, F.lit("] "), F.array_join(F.transform(events, one), " "))


def basic(ntypes: Column, events: Column, nodes: bool = True, kinds: bool = True) -> tuple[Column, Column]:
    """Types forgotten: nodes 0, events 1."""
    if nodes:
        ntypes = F.transform(ntypes, lambda t: F.lit(0))
    if kinds:
        events = F.transform(events, lambda e: F.struct(e["i"], e["j"], F.lit(1).alias("c")))
    return ntypes, events


def _least(ntypes: Column, n: int, edges) -> Column:
    """The least text over all orders of ``n`` nodes; ``edges`` gives a form's edges under an order."""
    forms = []
    for p in permutations(range(n)):  # p[k] is the new name of node k
        named = F.array(*(F.lit(k) for k in p)) if n else F.array().cast("array<int>")
        old = sorted(range(n), key=lambda k: p[k])
        types = F.array_join(F.array(*(F.get(ntypes, F.lit(k)).cast("string") for k in old)), ",") if n else F.lit("")
        forms.append(F.concat(F.lit("["), types, F.lit("] "), F.array_join(F.array_sort(edges(lambda x, named=named: F.get(named, x))), " ")))
    return F.array_min(F.array(*forms))


def _searched(form: str):
    """A UDF of node types and events to a canonical text, for any number of nodes; null for null."""
    search = searcher()

    def least(ntypes, events):
        if ntypes is None or events is None:
            return None
        n = len(ntypes)
        if form == "multigraph":
            edges = [(e[0], e[1], f":{e[2]}") for e in events]
        elif form == "digraph":
            edges = sorted({(e[0], e[1], "") for e in events})
        else:
            edges = sorted({(min(e[0], e[1]), max(e[0], e[1]), "") for e in events})

        def text(names):
            mark = "-" if form == "graph" else ">"
            types = [""] * n
            for k, name in enumerate(names):
                types[name] = str(ntypes[k])
            ends = [(names[i], names[j], c) for i, j, c in edges]
            if form == "graph":
                ends = [(min(a, b), max(a, b), c) for a, b, c in ends]
            return f"[{','.join(types)}] {' '.join(sorted(f'{a}{mark}{b}{c}' for a, b, c in ends))}"

        both = edges + [(j, i, c) for i, j, c in edges] if form == "graph" else edges
        return search(list(ntypes), both, text)[0]

    return F.udf(least, "string", useArrow=True)


def unordered(ntypes: Column, events: Column, form: str) -> Column:
    """The canonical text of a form that forgets the order of events.

    ``multigraph`` keeps directions, multiplicities and both kinds of types;
    ``digraph`` distinct directed edges and node types; ``graph`` distinct
    undirected edges and node types. Up to ``MOST_NODES`` nodes the text is the
    least over all orders of nodes, beyond them the least of the orders that a
    search by colours leaves: equal for two forms exactly where they are isomorphic.
    """
    text = lambda i, j, mark: F.concat(i.cast("string"), F.lit(mark), j.cast("string"))

    def edges(name) -> Column:
        if form == "multigraph":
            return F.transform(events, lambda e: F.concat(text(name(e["i"]), name(e["j"]), ">"), F.lit(":"), e["c"].cast("string")))
        if form == "digraph":
            return F.array_distinct(F.transform(events, lambda e: text(name(e["i"]), name(e["j"]), ">")))
        if form == "graph":
            return F.array_distinct(F.transform(events, lambda e: text(F.least(name(e["i"]), name(e["j"])), F.greatest(name(e["i"]), name(e["j"])), "-")))
        raise ValueError(form)

    large = F.size(ntypes) > MOST_NODES
    out = F.when(large, _searched(form)(F.when(large, ntypes), F.when(large, events)))
    for n in range(MOST_NODES, 0, -1):
        out = F.when(F.size(ntypes) == n, _least(ntypes, n, edges)).otherwise(out)
    return out


def canonical(ntypes: Column, events: Column, form: str = "motif") -> Column:
    """The key of a motif at a level: ``motif``, ``order``, ``multigraph``, ``digraph``, ``graph`` or ``nodes``.

    ``order`` keeps of the events' order only what nodes that they share give.
    """
    if form == "motif":
        return key(ntypes, events)
    if form == "order":
        return partial_key(ntypes, events)
    if form == "nodes":
        return F.array_join(F.transform(F.array_sort(ntypes), lambda t: t.cast("string")), ",")
    return unordered(ntypes, events, form)


def roles(n_nodes: Column, events: Column) -> Column:
    """A letter for each node: C caller, R receiver, T causal transmitter, N non-causal."""
    begin = F.transform(F.sequence(F.lit(1), n_nodes), lambda _: F.lit(""))
    sender = lambda r: F.when(r == "", "C").when(r == "R", "T").otherwise(r)
    receiver = lambda r: F.when(r == "", "R").when(r == "R", "R").otherwise("N")
    fold = lambda a, e: F.transform(a, lambda r, k: F.when(k == e["i"], sender(r)).when(k == e["j"], receiver(r)).otherwise(r))
    return F.aggregate(events, begin, fold)


def edge_labels(events: Column) -> Column:
    """``i>j:1,3`` for each directed edge: the places of its events in the order."""
    pairs = F.array_distinct(F.transform(events, lambda e: F.struct(e["i"], e["j"])))
    places = lambda p: F.filter(F.transform(events, lambda e, k: F.when((e["i"] == p["i"]) & (e["j"] == p["j"]), k + 1)), lambda x: x.isNotNull())
    label = lambda p: F.concat(p["i"].cast("string"), F.lit(">"), p["j"].cast("string"), F.lit(":"), F.array_join(F.transform(places(p), lambda x: x.cast("string")), ","))
    return F.transform(pairs, label)


def properties(ntypes: Column, events: Column) -> dict[str, Column]:
    """Numbers of nodes, events, undirected and directed edges."""
    flat = F.transform(events, lambda e: F.struct(F.least(e["i"], e["j"]).alias("i"), F.greatest(e["i"], e["j"]).alias("j")))
    return {
        "nof_nodes": F.size(ntypes),
        "nof_events": F.size(events),
        "nof_edges": F.size(F.array_distinct(flat)),
        "nof_dir_edges": F.size(F.array_distinct(F.transform(events, lambda e: F.struct(e["i"], e["j"])))),
    }


def parse(motif: Column) -> tuple[Column, Column]:
    """Node types and events back from a key."""
    types = F.transform(F.split(F.regexp_extract(motif, r"^\[([^\]]*)\]", 1), ","), lambda t: t.cast("int"))
    part = lambda k: F.regexp_extract_all(motif, F.lit(r"(\d+)>(\d+):(-?\d+)"), F.lit(k))
    events = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("d")), lambda x: F.struct(x["a"].cast("int").alias("i"), x["b"].cast("int").alias("j"), x["d"].cast("int").alias("c")))
    return types, events


def remapped(ntypes: Column, events: Column, type_map: dict[int, int]) -> tuple[Column, Column]:
    """Types replaced by a map; others stay."""
    if not type_map:
        return ntypes, events
    table = F.create_map(*(F.lit(x) for kv in type_map.items() for x in kv))
    swap = lambda t: F.coalesce(F.try_element_at(table, t), t)
    return F.transform(ntypes, swap), F.transform(events, lambda e: F.struct(e["i"], e["j"], swap(e["c"]).alias("c")))


def count_text(n: Column) -> Column:
    """A number as text, in thousands and millions where it is large."""
    short = lambda d, mark: F.concat(F.regexp_replace(F.format_string("%.1f", n / d), r"\.0$", ""), F.lit(mark))
    return F.when(n >= 1_000_000, short(1e6, "M")).when(n >= 10_000, short(1e3, "k")).otherwise(n.cast("string"))
