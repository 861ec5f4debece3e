"""Join order for the patterns of a basic graph pattern, from predicate statistics.

Cardinalities follow System R: |A| * |B| / product over shared variables of the
larger number of distinct values. Up to ``BUSHY`` patterns the best tree over
connected sets is found by dynamic programming; larger patterns are joined
greedily. Without statistics, constants decide.
"""

from __future__ import annotations

from dataclasses import dataclass

BUSHY = 9


@dataclass
class Leaf:
    number: int
    card: float
    ndv: dict  # variable -> distinct values


def join_card(a: Leaf, b: Leaf) -> Leaf:
    shared = a.ndv.keys() & b.ndv.keys()
    card = a.card * b.card
    for v in shared:
        card /= max(a.ndv[v], b.ndv[v], 1.0)
    ndv = {v: min(a.ndv.get(v, float("inf")), b.ndv.get(v, float("inf")), max(card, 1.0)) for v in a.ndv.keys() | b.ndv.keys()}
    return Leaf(-1, max(card, 1e-3), ndv)


def plan(leaves: list[Leaf]):
    """A nested pair tree of leaf numbers."""
    if len(leaves) == 1:
        return leaves[0].number
    return _exhaustive(leaves) if len(leaves) <= BUSHY else _greedy(leaves)


def _exhaustive(leaves: list[Leaf]):
    best = {1 << k: (0.0, leaf, leaf.number) for k, leaf in enumerate(leaves)}
    full = (1 << len(leaves)) - 1
    for mask in sorted(range(1, full + 1), key=int.bit_count):
        if mask in best:
            continue
        options = []
        for connected in (True, False):
            part = (mask - 1) & mask
            while part:
                rest = mask ^ part
                if part > rest and part in best and rest in best:
                    a, b = best[part], best[rest]
                    if bool(a[1].ndv.keys() & b[1].ndv.keys()) == connected:
                        out = join_card(a[1], b[1])
                        options.append((a[0] + b[0] + out.card, out, (a[2], b[2])))
                part = (part - 1) & mask
            if options:
                break
        if options:
            best[mask] = min(options, key=lambda o: o[0])
    return best[full][2]


def _greedy(leaves: list[Leaf]):
    parts = [(leaf, leaf.number) for leaf in leaves]
    parts.sort(key=lambda p: p[0].card)
    now, tree = parts.pop(0)
    while parts:
        linked = [p for p in parts if p[0].ndv.keys() & now.ndv.keys()] or parts
        nxt = min(linked, key=lambda p: join_card(now, p[0]).card)
        parts.remove(nxt)
        now, tree = join_card(now, nxt[0]), (tree, nxt[1])
    return tree
