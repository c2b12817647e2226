"""Canonical names for the vertices of small coloured graphs, found inside a task.

Functions are nested, so that workers need no package.
"""

from __future__ import annotations


def searcher():
    """A function ``search(colours, arcs, text)`` to the least text and the names that give it.

    ``colours`` has one for each vertex, ``arcs`` are ``(from, to, label)``, and
    ``text(names)`` writes the graph out under new names, so that equal texts
    mean equal graphs. Vertices are coloured by theirs and then by their
    neighbours' colours until that parts no more; where some share a colour, each
    in turn is told apart. Names that give a known text show a symmetry, and what
    is symmetric to what was searched before is passed over.
    """

    def ranks(values):
        at = {v: k for k, v in enumerate(sorted(set(values)))}
        return [at[v] for v in values]

    def search(colours, arcs, text):
        n = len(colours)
        ways = [[] for _ in range(n)]
        for i, j, label in arcs:
            ways[i].append((0, label, j))
            ways[j].append((1, label, i))

        def refined(colours):
            while True:
                new = ranks([(colours[k], tuple(sorted((d, c, colours[o]) for d, c, o in ways[k]))) for k in range(n)])
                if len(set(new)) == len(set(colours)):
                    return new
                colours = new

        known, symmetries = {}, []

        def same(path, one, two):
            """Whether known symmetries that leave the path as it is bring one vertex to the other."""
            fixing = [s for s in symmetries if all(s[k] == k for k in path)]
            seen, todo = {one}, [one]
            while todo:
                k = todo.pop()
                for s in fixing:
                    if s[k] not in seen:
                        seen.add(s[k])
                        todo.append(s[k])
            return two in seen

        def visit(colours, path):
            """Search below a path; the depth to go back to."""
            colours = refined(colours)
            cells = {}
            for k, c in enumerate(colours):
                cells.setdefault(c, []).append(k)
            open_cells = [(len(ks), c) for c, ks in cells.items() if len(ks) > 1]
            if not open_cells:
                t = text(colours)
                if t not in known:
                    known[t] = (colours, path)
                    return len(path)
                names, before = known[t]
                here = {name: k for k, name in enumerate(colours)}
                symmetries.append([here[names[k]] for k in range(n)])
                there = {name: k for k, name in enumerate(names)}
                symmetries.append([there[colours[k]] for k in range(n)])
                return next((d for d, (a, b) in enumerate(zip(path, before)) if a != b), len(path))
            done = []
            for k in cells[min(open_cells)[1]]:
                if any(same(path, d, k) for d in done):
                    continue
                back = visit([2 * c + (o != k) for o, c in enumerate(colours)], [*path, k])
                if back < len(path):
                    return back
                done.append(k)
            return len(path)

        visit(ranks(list(colours)), [])
        least = min(known)
        return least, known[least][0]

    return search
