"""Property paths as sets of (a, b) pairs of canonical strings.

Closures run semi-naively over DataFrames: from a constant end only the frontier
is joined with the steps; with both ends free the new pairs are composed with all
known ones, which needs a logarithmic number of rounds. Each round is written to
the shared folder; every few rounds what is known is written anew as one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Val
from ..storage import written

#: Rounds after which a union of rounds becomes one table.
COMPACT = 8


class Paths:
    def __init__(self, compiler):
        self.c = compiler

    def pairs(self, path: tuple, start: str | None = None, end: str | None = None) -> DataFrame:
        """Distinct pairs of a path; ``start`` and ``end`` are constants that seed closures."""
        head = path[0]
        if head == "iri":
            return self._ends(self.c.steps(path[1]), start, end)
        if head == "inv":
            return self.pairs(path[1], end, start).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if head == "seq":
            out = self.pairs(path[1], start, end if len(path) == 2 else None)
            for k, step in enumerate(path[2:], 2):
                right = self.pairs(step, None, end if k == len(path) - 1 else None)
                out = out.join(right.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
            return out.distinct()
        if head == "alt":
            out = self.pairs(path[1], start, end)
            for arm in path[2:]:
                out = out.unionAll(self.pairs(arm, start, end))
            return out.distinct()
        if head == "neg":
            banned = [f"<{name}>" for inverse, name in path[1:] if not inverse]
            triples = self.c.triples()
            if banned:
                triples = triples.where(~F.col("p").isin(banned))
            return self._ends(triples.select(F.col("s").alias("a"), F.col("o").alias("b")), start, end).distinct()
        if head == "opt":
            return self._ends(self.pairs(path[1], start, end).unionAll(self.identity(start, end)), start, end).distinct()
        closure = self.closure(self.pairs(path[1]), start, end)
        if head == "star":
            closure = self._ends(closure.unionAll(self.identity(start, end)), start, end).distinct()
        return closure

    @staticmethod
    def _ends(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
        if start is not None:
            df = df.where(F.col("a") == start)
        return df if end is None else df.where(F.col("b") == end)

    def identity(self, start: str | None, end: str | None) -> DataFrame:
        """(x, x) for the terms of the graph, or for the constant end if it is one of them."""
        triples = self.c.triples()
        nodes = triples.select(F.col("s").alias("a")).unionAll(triples.select("o"))
        if start is not None or end is not None:
            nodes = nodes.where(F.col("a") == (start if start is not None else end)).limit(1)
        return nodes.distinct().select("a", F.col("a").alias("b"))

    def closure(self, steps: DataFrame, start: str | None, end: str | None) -> DataFrame:
        steps = written(steps, "steps")
        if start is None and end is None:
            return transitive(steps)
        if start is None:
            flipped = steps.select(F.col("b").alias("a"), F.col("a").alias("b"))
            return reach(flipped, flipped.where(F.col("a") == end)).select(F.col("b").alias("a"), F.col("a").alias("b"))
        return self._ends(reach(steps, steps.where(F.col("a") == start)), None, end)


def reach(steps: DataFrame, first: DataFrame) -> DataFrame:
    """All (a, b) with b reached from the pairs ``first`` by further steps."""
    seen = frontier = written(first.select("a", "b").distinct(), "reach")
    onward, level = steps.select(F.col("a").alias("b"), F.col("b").alias("c")), 0
    while not frontier.isEmpty():
        more = frontier.join(onward, "b").select("a", F.col("c").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        frontier = written(more, "reach")
        seen, level = seen.unionAll(frontier), level + 1
        if level % COMPACT == 0:
            seen = written(seen, "reach")
    return seen


def transitive(steps: DataFrame) -> DataFrame:
    """The transitive closure, by doubling: each round composes the pairs that are new with
    all that are known, on either side, and keeps what is new again."""
    known = new = written(steps.select("a", "b").distinct(), "closure")
    turn = 0
    while not new.isEmpty():
        after = new.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
        before = known.join(new.select(F.col("a").alias("b"), F.col("b").alias("c")), "b")
        longer = after.unionAll(before).select("a", F.col("c").alias("b")).distinct()
        new = written(longer.join(known, ["a", "b"], "left_anti"), "closure")
        known, turn = known.unionAll(new), turn + 1
        if turn % COMPACT == 0:
            known = written(known, "closure")
    return known


def graph_function(compiler, name: str, args: list[Val]) -> Val:
    """CYCLEBOOLEAN, SHORTESTPATHLEN and KHOPREACHABLE over the entity graph of the store."""
    from .graph import Graph

    graph = compiler.__dict__.setdefault("entity_graph", None) or Graph.of_triples(compiler.triples())
    compiler.entity_graph = graph
    if name in ("CYCLEBOOLEAN", "SIMPLECYCLEBOOLEAN"):
        return Val("bool", F.lit(graph.has_cycle()))
    a, b = V.to_nt(args[0]), V.to_nt(args[1])
    if args[0].fixed is not None and args[1].fixed is not None:
        got = graph.distance(V.nt(args[0].fixed), V.nt(args[1].fixed))
        length: Column = F.lit(got).cast("long")
    else:
        one = args[0].fixed or args[1].fixed
        if one is None:
            raise ValueError(f"{name} needs a constant as one of its first two arguments")
        hops = graph.bfs(V.nt(one), reverse=args[0].fixed is None)
        other = b if args[0].fixed is not None else a
        table = hops.select(F.col("node").alias("n_"), F.col("hops").alias("h_"))
        found = table.where(F.col("n_") == _outer(other)).select(F.max("h_")).scalar()
        known = graph.nodes.where(F.col("node") == _outer(other)).select(F.count("*")).scalar()
        length = F.when(known > 0, F.coalesce(found.cast("long"), F.lit(-1)))
    if name == "SHORTESTPATHLEN":
        return V.number(length, length.cast("double"), True)
    k = V.int_of(args[2])
    return Val("bool", (length >= 0) & ((k < 0) | (length <= k)))


def _outer(c: Column) -> Column:
    return c.outer()
