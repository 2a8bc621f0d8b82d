"""Canonical form of one small labelled graph; called once per distinct structure, never per query."""

from __future__ import annotations

import json


def _refine(colour: list, edges: list) -> list[int]:
    """Split node colours by the colours and labels around each node until nothing changes."""
    ranks = {c: i for i, c in enumerate(sorted(set(colour)))}
    colour = [ranks[c] for c in colour]
    while True:
        around: list[list] = [[] for _ in colour]
        for a, b, label in edges:
            if a == b:
                around[a].append((2, label, colour[a]))
            else:
                around[a].append((1, label, colour[b]))
                around[b].append((0, label, colour[a]))
        seen = [(colour[i], tuple(sorted(around[i]))) for i in range(len(colour))]
        ranks = {c: i for i, c in enumerate(sorted(set(seen)))}
        if len(ranks) == len(set(colour)):
            return colour
        colour = [ranks[c] for c in seen]


def _core(n: int, edges: list) -> set[int]:
    """Nodes that stay when nodes with at most one neighbour are removed again and again."""
    near: list[set] = [set() for _ in range(n)]
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    loose = [i for i in range(n) if len(near[i]) <= 1]
    core = set(range(n))
    while loose:
        i = loose.pop()
        if i not in core:
            continue
        core.discard(i)
        for j in near[i] & core:
            near[j].discard(i)
            if len(near[j]) <= 1:
                loose.append(j)
    return core


def _parts(n: int, edges: list) -> list[list[int]]:
    """Nodes of each connected part."""
    part = list(range(n))

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i
    for a, b, _ in edges:
        part[root(a)] = root(b)
    out: dict[int, list[int]] = {}
    for i in range(n):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


def canonical_form(structure: str) -> str:
    """Equal for isomorphic structures and only for those.

    ``structure`` is JSON ``{"g": [group of node i, ...], "e": [[i, j, label], ...]}``. Connected parts have their own
    forms, so equal parts side by side cost no search.
    """
    data = json.loads(structure)
    forms = []
    for nodes in _parts(len(data["g"]), data["e"]):
        number = {i: k for k, i in enumerate(nodes)}
        edges = [(number[a], number[b], label) for a, b, label in data["e"] if a in number]
        forms.append(_part_form([data["g"][i] for i in nodes], edges))
    return json.dumps(sorted(forms))


def _orbits(nodes: list[int], colour: list[int], found: list[dict[int, int]]) -> dict[int, int]:
    """Core nodes with a name of their orbit under those of the automorphisms found that keep this colouring."""
    name = {i: i for i in nodes}

    def root(i: int) -> int:
        while name[i] != i:
            i = name[i]
        return i
    for swap in found:
        if all(colour[a] == colour[b] for a, b in swap.items()):
            for a, b in swap.items():
                name[root(a)] = root(b)
    return {i: root(i) for i in nodes}


def _part_form(groups: list, edges: list) -> str:
    """Form of one connected part. Refined colours decide trees hanging off the cyclic core, so only core nodes of equal
    colour are tried in turn. Two trials that end in the same text give an automorphism of the part; a node that known
    automorphisms move to a tried one needs no trial, so equal branches cost one descent each instead of a search."""
    core = sorted(_core(len(groups), edges))
    found: list[dict[int, int]] = []

    def links(i: int, swap: int) -> tuple:
        def name(k: int) -> int:
            return -1 if k in (i, swap) else k
        return tuple(sorted((name(a), name(b), a == i, label) for a, b, label in edges if i in (a, b)))

    def open_cell(colour: list[int]) -> list[int] | None:
        cells: dict[int, list[int]] = {}
        for i in core:
            cells.setdefault(colour[i], []).append(i)
        return min((c for c in cells.values() if len(c) > 1), key=lambda c: (len(c), colour[c[0]]), default=None)

    def without(i: int, colour: list[int]) -> list[int]:
        """The colours once i has one of its own."""
        split = [(c, 1) for c in colour]
        split[i] = (colour[i], 0)
        return _refine(split, edges)

    def text(colour: list[int]) -> str:
        return json.dumps([sorted([colour[i], groups[i]] for i in range(len(groups))),
                           sorted((colour[a], colour[b], a == b, label) for a, b, label in edges)])

    def best(colour: list[int]) -> str:
        cell = open_cell(colour)
        if cell is None:
            return text(colour)
        tried: list[int] = []
        ends: dict[str, list[int]] = {}
        form = None
        for i in cell:
            twin = next((j for j in tried if links(i, j) == links(j, i)), None)
            if twin is not None:
                found.append({i: twin, twin: i})
                continue
            orbit = _orbits(core, colour, found)
            if any(orbit[i] == orbit[j] for j in tried):
                continue
            tried.append(i)
            split = end = without(i, colour)
            while (rest := open_cell(end)) is not None:
                end = without(rest[0], end)
            known = ends.setdefault(text(end), end)
            if known is not end:
                at = {known[k]: k for k in core}
                found.append({at[end[k]]: k for k in core})
                continue
            trial = best(split)
            form = trial if form is None or trial < form else form
        return form

    return best(_refine(list(groups), edges))
