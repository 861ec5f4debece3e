"""Random patterns on random tiny graphs: compiled plans against a naive evaluator."""

import random
from collections import Counter

import pytest

from tripleframe.store import Store

VARS = ["x", "y", "z", "w"]
NODES = [f"<n{k}>" for k in range(4)]
PREDICATES = ["<p>", "<q>"]


def compatible(a, b):
    return all(a[v] == b[v] for v in a if v in b)


def evaluate(p, graph):
    """Solutions as dicts (unbound variables are missing), a bag."""
    kind = p[0]
    if kind == "bgp":
        out = [{}]
        for triple in p[1]:
            new = []
            for row in out:
                for t in graph:
                    now = dict(row)
                    if all((now.setdefault(x[1:], y) == y) if x.startswith("?") else x == y for x, y in zip(triple, t, strict=True)):
                        new.append(now)
            out = new
        return out
    left, right = evaluate(p[1], graph), evaluate(p[2], graph)
    if kind == "union":
        return left + right
    if kind == "join":
        return [{**a, **b} for a in left for b in right if compatible(a, b)]
    if kind == "optional":
        out = []
        for a in left:
            hits = [{**a, **b} for b in right if compatible(a, b)]
            out += hits or [a]
        return out
    return [a for a in left if not any(compatible(a, b) and a.keys() & b.keys() for b in right)]


def text(p):
    if p[0] == "bgp":
        return " . ".join(" ".join(t) for t in p[1])
    a, b = f"{{ {text(p[1])} }}", f"{{ {text(p[2])} }}"
    return {"union": f"{a} UNION {b}", "join": f"{a} {b}", "optional": f"{a} OPTIONAL {b}", "minus": f"{a} MINUS {b}"}[p[0]]


def pattern(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        term = lambda: f"?{rng.choice(VARS)}" if rng.random() < 0.75 else rng.choice(NODES)
        return ("bgp", [(term(), rng.choice(PREDICATES), term()) for _ in range(rng.randint(1, 2))])
    return (rng.choice(["union", "join", "optional", "minus"]), pattern(rng, depth - 1), pattern(rng, depth - 1))


@pytest.mark.parametrize("seed", range(16))
def test_random_patterns(spark, seed):
    rng = random.Random(seed)
    graph = sorted({(rng.choice(NODES), rng.choice(PREDICATES), rng.choice(NODES)) for _ in range(7)})
    store = Store(spark, spark.createDataFrame([(None, *t) for t in graph], "g string, s string, p string, o string"))
    for _ in range(2):
        p = pattern(rng, 2)
        got = Counter(tuple(r) for r in store.select(f"SELECT ?x ?y ?z ?w WHERE {{ {text(p)} }}", "ntriples").collect())
        assert got == Counter(tuple(row.get(v) for v in VARS) for row in evaluate(p, graph)), text(p)
