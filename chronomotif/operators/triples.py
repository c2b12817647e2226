"""How many places of three edges look alike, counted without making them.

A place of three edges is a star, a path or a triangle, or has fewer nodes and
edges side by side. What a node has is summed by kind (direction, type and bin
of an edge, type of its other end); products of these sums count all ways of
choosing edges there, ends that coincide included. Coincidences are counted by
themselves, from pairs of nodes with several edges and from triangles, and taken
off by inclusion and exclusion. Rows are kinds of edges at a node, never its
edges, so that a node of any degree brings no more rows than there are kinds.

Each base table gives signed counts of one or more forms. A form names its
nodes by numbers; edges that are written with them are relabelled by first
appearance, as those of places are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomotif.functions.canonical import relabelled
from chronomotif.operators.subgraphs import nodes_of
from chronomotif.storage import saved

#: Of three edges in order, two on the same pair of nodes and the third.
DOUBLED = ((0, 1, 2), (0, 2, 1), (1, 2, 0))
#: Of a path's three edges in order: the middle one, that at its source, that at its target. The last can't be the middle:
#: the two before it would not meet.
PATHS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0))


def _form(sign: int, ends: dict[int, tuple[int, int]], kinds: list[str], types: list[str], when: Column | None = None) -> Column:
    """A signed form. ``ends`` has for each edge in order the node it is seen from and the other; ``kinds`` the columns of its kind."""
    edge = lambda h, near, far: F.struct(
        F.when(h["out"], F.lit(near)).otherwise(F.lit(far)).alias("src"), F.when(h["out"], F.lit(far)).otherwise(F.lit(near)).alias("dst"), h["c"].alias("etype")
    )
    columns = [F.col(k) for k in kinds]
    made = F.struct(
        F.lit(sign).alias("sign"),
        F.array(*(edge(columns[k], *ends[k]) for k in range(3))).alias("edges"),
        F.array(*(h["bin"] for h in columns)).alias("bins"),
        F.array(*types).alias("types"),
    )
    return made if when is None else F.when(when, made)


def _signed(base: DataFrame, forms: list[Column]) -> DataFrame:
    rows = base.select("n", F.explode(F.array(*forms)).alias("x")).filter("x is not null").select("x.*", "n")
    types = F.transform(nodes_of(), lambda k: F.get("types", k))
    return rows.select(types.alias("ntypes"), relabelled().alias("events"), "bins", (F.col("sign") * F.col("n")).alias("n"))


def _views(bnet: DataFrame, mixed: bool) -> DataFrame:
    """Every edge as seen from either end: ``u, v, tu, tv, k`` and its kind ``h``; ``k`` is the type that all edges of a place share."""
    k = F.lit(0) if mixed else F.col("etype")
    kind = lambda out: F.struct(F.lit(out).alias("out"), F.col("etype").alias("c"), F.col("bin").alias("bin")).alias("h")
    ahead = bnet.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("st").alias("tu"), F.col("dt").alias("tv"), k.alias("k"), kind(True))
    back = bnet.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("dt").alias("tu"), F.col("st").alias("tv"), k.alias("k"), kind(False))
    return ahead.unionByName(back)


def _named(df: DataFrame, **names: str) -> DataFrame:
    """Columns under other names; those not named go."""
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def stars(at: DataFrame) -> DataFrame:
    """Three edges of a node, to any leaves. ``at`` has ``u, k, tu, e, n``; ``e`` is a kind and the leaf's type."""
    one = _named(at, u="u", k="k", t="tu", e1="e", n1="n")
    two, three = (_named(at, u="u", k="k", **{f"e{j}": "e", f"n{j}": "n"}) for j in (2, 3))
    # Each choice of kinds once, then in every order.
    rows = one.join(two, ["u", "k"]).filter("e1 <= e2").join(three, ["u", "k"]).filter("e2 <= e3")
    sums = rows.groupBy("t", "e1", "e2", "e3").agg(F.sum(F.col("n1") * F.col("n2") * F.col("n3")).alias("n"))
    orders = F.array_distinct(F.array(*(F.array(*p) for p in permutations(("e1", "e2", "e3")))))
    rows = sums.select("t", "n", F.explode(orders).alias("e"))
    base = rows.select("n", "t", *(F.col("e")[j]["h"].alias(f"h{j}") for j in range(3)), *(F.col("e")[j]["f"].alias(f"f{j}") for j in range(3)))
    return _signed(base, [_form(1, {j: (0, j + 1) for j in range(3)}, ["h0", "h1", "h2"], ["t", "f0", "f1", "f2"])])


def doubles(views: DataFrame, at: DataFrame) -> DataFrame:
    """Two edges to one leaf and one to any: those forms, and what they take from stars and paths."""
    pair = ["u", "v", "k"]
    second = _named(views, u="u", v="v", k="k", hb="h")
    both = _named(views, u="u", v="v", k="k", t="tu", f="tv", ha="h").join(second, pair).groupBy("u", "k", "t", "f", "ha", "hb").agg(F.count("*").alias("na"))
    rows = both.join(_named(at, u="u", k="k", e="e", nb="n"), ["u", "k"])
    base = rows.groupBy("t", "ha", "hb", "f", F.col("e")["h"].alias("hs"), F.col("e")["f"].alias("fs")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    forms = []
    for i, j, k in DOUBLED:
        kinds = [""] * 3
        kinds[i], kinds[j], kinds[k] = "ha", "hb", "hs"
        forms.append(_form(1, {i: (0, 1), j: (0, 1), k: (0, 2)}, kinds, ["t", "f", "fs"]))
        forms.append(_form(-1, {i: (0, 1), j: (0, 2), k: (0, 3)}, kinds, ["t", "f", "f", "fs"]))
        # A path whose end at the leaf is the centre: its middle is one of the two, the end the other.
        for middle, end in ((i, j), (j, i)):
            if middle < 2:
                forms.append(_form(-1, {middle: (0, 1), end: (3, 1), k: (0, 2)}, kinds, ["t", "f", "fs", "t"]))
    return _signed(base, forms)


def parallels(views: DataFrame) -> DataFrame:
    """Three edges between two nodes: that form, and what they correct in the others."""
    pair = ["u", "v", "k"]
    rows = _named(views, u="u", v="v", k="k", t="tu", f="tv", h0="h")
    for j in (1, 2):
        rows = rows.join(_named(views, u="u", v="v", k="k", **{f"h{j}": "h"}), pair)
    base = rows.groupBy("t", "f", "h0", "h1", "h2").agg(F.count("*").alias("n"))
    kinds = ["h0", "h1", "h2"]
    forms = [_form(1, {j: (0, 1) for j in range(3)}, kinds, ["t", "f"], F.col("h0")["out"]), _form(2, {j: (0, j + 1) for j in range(3)}, kinds, ["t", "f", "f", "f"])]
    forms += [_form(-1, {i: (0, 1), j: (0, 1), k: (0, 2)}, kinds, ["t", "f", "f"]) for i, j, k in DOUBLED]
    forms += [_form(1, {m: (0, 1), p: (0, 2), q: (3, 1)}, kinds, ["t", "f", "f", "t"], F.col(f"h{m}")["out"]) for m, p, q in PATHS]
    return _signed(base, forms)


def paths(views: DataFrame, at: DataFrame) -> DataFrame:
    """An edge with one at its source and one at its target, to any ends."""
    middle = _named(views.filter("h.out"), u="u", v="v", k="k", t="tu", f="tv", hm="h")
    source = _named(at, u="u", k="k", ep="e", np="n")
    into = middle.join(source, ["u", "k"]).groupBy("v", "k", "t", "f", "hm", "ep").agg(F.sum("np").alias("np"))
    target = _named(at, v="u", k="k", eq="e", nq="n")
    rows = into.join(target, ["v", "k"]).groupBy("t", "f", "hm", "ep", "eq").agg(F.sum(F.col("np") * F.col("nq")).alias("n"))
    base = rows.select("n", "t", "f", "hm", *(F.col(f"e{x}")["h"].alias(f"h{x}") for x in "pq"), *(F.col(f"e{x}")["f"].alias(f"f{x}") for x in "pq"))
    forms = []
    for m, p, q in PATHS:
        kinds = [""] * 3
        kinds[m], kinds[p], kinds[q] = "hm", "hp", "hq"
        forms.append(_form(1, {m: (0, 1), p: (0, 2), q: (1, 3)}, kinds, ["t", "f", "fp", "fq"]))
    return _signed(base, forms)


def closed(views: DataFrame) -> DataFrame:
    """Three edges around a triangle: that form, and what they take from paths.

    Triangles are found from their node of least degree, where a node meets few others.
    """
    pairs = views.select("k", "u", "v").distinct()
    degree = pairs.groupBy("k", "u").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree, ["k", "u"]).join(_named(degree, k="k", v="u", dv="d"), ["k", "v"])
    up = saved(ranked.filter(F.struct("d", "u") < F.struct(F.col("dv").alias("d"), F.col("v").alias("u"))).select("k", "u", "v", "dv"), "upward")
    first, second = _named(up, k="k", a="u", b="v", db="dv"), _named(up, k="k", a="u", c="v", dc="dv")
    wedge = first.join(second, ["k", "a"]).filter(F.struct(F.col("db").alias("d"), F.col("b").alias("x")) < F.struct(F.col("dc").alias("d"), F.col("c").alias("x")))
    found = wedge.join(_named(up, k="k", b="u", c="v"), ["k", "b", "c"]).select("k", F.array("a", "b", "c").alias("abc"))
    turns = F.array(*(F.struct(*(F.col("abc")[x].alias(name) for x, name in zip(p, "xyz", strict=True))) for p in permutations(range(3))))
    rows = found.select("k", F.explode(turns).alias("p")).select("k", "p.*")
    rows = rows.join(_named(views.filter("h.out"), k="k", x="u", y="v", t="tu", f="tv", hm="h"), ["k", "x", "y"])
    rows = rows.join(_named(views, k="k", x="u", z="v", g="tv", hp="h"), ["k", "x", "z"]).join(_named(views, k="k", y="u", z="v", hq="h"), ["k", "y", "z"])
    base = rows.groupBy("t", "f", "g", "hm", "hp", "hq").agg(F.count("*").alias("n"))
    forms = []
    for m, p, q in PATHS:
        kinds = [""] * 3
        kinds[m], kinds[p], kinds[q] = "hm", "hp", "hq"
        if m == 0:
            forms.append(_form(1, {m: (0, 1), p: (0, 2), q: (1, 2)}, kinds, ["t", "f", "g"]))
        forms.append(_form(-1, {m: (0, 1), p: (0, 2), q: (1, 3)}, kinds, ["t", "f", "g", "g"]))
    return _signed(base, forms)


def triple_totals(bnet: DataFrame, mixed_types: bool = False) -> DataFrame:
    """``ntypes, events, bins, n`` of all places of three edges. Counts beyond a long raise."""
    views = saved(_views(bnet, mixed_types), "edge-views")
    at = saved(views.groupBy("u", "k", "tu", F.struct("h", F.col("tv").alias("f")).alias("e")).agg(F.count("*").alias("n")), "node-kinds")
    rows = stars(at)
    for part in (doubles(views, at), parallels(views), paths(views, at), closed(views)):
        rows = rows.unionByName(part)
    return rows.groupBy("ntypes", "events", "bins").agg(F.sum("n").alias("n")).filter("n > 0")
