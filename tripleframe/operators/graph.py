"""Graph analytics over edges as DataFrames.

``Graph`` is the entity view: directed, simple, edges (a, b); every triple is an
edge from subject to object and literals are nodes. ``WeightedGraph`` keeps the
predicate and a weight. Traversals, components, ranks and cores are fixpoint loops
of joins and aggregates; every round is written to the shared folder, so a lost
executor costs one round. Path-counting centralities and Louvain run from
``EXACT_EDGES`` edges at most, checked, in Arrow tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import discard, written

#: Operators that hold the whole edge list in a task refuse larger graphs.
EXACT_EDGES = 5_000_000


class TooLarge(ValueError):
    """The graph is too large for an operator that needs all edges in one task."""


class Graph:
    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges = edges.select("a", "b").distinct()
        ends = self.edges.select(F.col("a").alias("node")).unionAll(self.edges.select("b"))
        self.nodes = (ends if nodes is None else ends.unionAll(nodes.select("node"))).distinct()

    @classmethod
    def of_triples(cls, triples: DataFrame) -> Graph:
        return cls(triples.select(F.col("s").alias("a"), F.col("o").alias("b")))

    def fixed(self) -> Graph:
        """The same graph with edges and nodes written once, for loops."""
        if not hasattr(self, "_fixed"):
            out = object.__new__(Graph)
            out.edges, out.nodes = written(self.edges, "edges"), written(self.nodes, "nodes")
            out._fixed = out
            self._fixed = out
        return self._fixed

    # --- sizes and degrees
    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def degrees(self) -> DataFrame:
        """node, out_degree, in_degree of distinct neighbours; zeros included."""
        both = self.edges.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(self.edges.select("b", F.lit(0), F.lit(1))).unionAll(self.nodes.select("node", F.lit(0), F.lit(0)))
        return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    def in_neighbors(self, node) -> DataFrame:
        return self.edges.where(F.col("b") == node).select(F.col("a").alias("node"))

    # --- traversal
    def bfs(self, source, reverse: bool = False, max_hops: int | None = None) -> DataFrame:
        """node, hops, parent: smallest parent of each level; the source has 0 hops. Unknown source: no rows."""
        g = self.fixed()
        edges = g.edges.select(F.col("b").alias("a"), F.col("a").alias("b")) if reverse else g.edges
        kind = g.nodes.schema["node"].dataType
        seen = frontier = written(g.nodes.where(F.col("node") == source).select("node", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent")), "bfs")
        level = 0
        while (max_hops is None or level < max_hops) and not frontier.isEmpty():
            level += 1
            step = frontier.join(edges, F.col("node") == F.col("a")).groupBy("b").agg(F.min("a").alias("parent"))
            new = step.select(F.col("b").alias("node"), F.lit(level).alias("hops"), "parent").join(seen.select("node"), "node", "left_anti")
            frontier = written(new, "bfs")
            seen = seen.unionAll(frontier)
            if level % 8 == 0:  # else the plan grows by an input a level
                seen = written(seen, "bfs")
        return seen

    def shortest_path(self, source, target) -> list | None:
        """Nodes of one shortest path, both ends included; None if there is none."""
        seen = written(self.bfs(source), "bfs")
        hit = seen.where(F.col("node") == target).first()
        if hit is None:
            return None
        path, node = [target], hit["parent"]
        for hops in range(hit["hops"] - 1, -1, -1):
            path.append(node)
            node = seen.where((F.col("node") == node) & (F.col("hops") == hops)).first()["parent"]
        return path[::-1]

    def distance(self, source, target) -> int | None:
        """Hops, -1 if unreachable, None if an end is no node."""
        g = self.fixed()
        if g.nodes.where(F.col("node").isin(source, target)).count() < len({source, target}):
            return None
        hit = self.bfs(source).where(F.col("node") == target).first()
        return -1 if hit is None else hit["hops"]

    def khop_reachable(self, source, target, hops: int) -> bool | None:
        g = self.fixed()
        if g.nodes.where(F.col("node").isin(source, target)).count() < len({source, target}):
            return None
        return not self.bfs(source, max_hops=None if hops < 0 else hops).where(F.col("node") == target).isEmpty()

    def has_cycle(self) -> bool:
        """Peels nodes without in- or out-edges; what stays is on a cycle."""
        edges = self.fixed().edges
        size = edges.count()
        while size:
            edges = written(edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"), "peel")
            now = edges.count()
            if now == size:
                return True
            size = now
        return False

    # --- components
    def weak_components(self) -> DataFrame:
        """node, component: the smallest node of the weakly connected component.

        Alternates large-star and small-star, a logarithmic number of rounds in practice.
        """
        g = self.fixed()
        now = written(g.edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "star")
        state = None
        while True:
            both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(now.select("hi", "lo"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
            down = large.groupBy("hi").agg(F.min("lo").alias("m"))
            small = large.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionAll(down.select("m", "hi")).where("lo < hi").distinct()
            last, now = now, written(small, "star")
            discard(last)
            row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
            if state == tuple(row):
                break
            state = tuple(row)
        return g.nodes.join(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))

    def strong_components(self) -> DataFrame:
        """node, component: the smallest node of the strongly connected component.

        Forward-backward colouring: every node takes the smallest node that reaches
        it; the nodes of a colour that reach the colour's root are its component.
        """
        g = self.fixed()
        edges, left, done = g.edges.where("a <> b"), g.nodes, None
        while not left.isEmpty():
            color = written(left.select("node", F.col("node").alias("color")), "scc")
            while True:
                better = color.join(edges, F.col("node") == F.col("a")).groupBy("b").agg(F.min("color").alias("c"))
                new = written(color.join(better, F.col("node") == F.col("b"), "left").select("node", F.least("color", F.coalesce("c", "color")).alias("color")), "scc")
                same = new.join(color.withColumnRenamed("color", "old"), "node").where("color <> old").isEmpty()
                color = new
                if same:
                    break
            own = edges.join(color.select(F.col("node").alias("a"), F.col("color").alias("ca")), "a").join(color.select(F.col("node").alias("b"), F.col("color").alias("cb")), "b").where("ca = cb").select("a", "b")
            own = written(own, "scc")
            found = frontier = written(color.where("node = color").select("node", "color"), "scc")
            while not frontier.isEmpty():
                back = frontier.join(own, F.col("node") == F.col("b")).select(F.col("a").alias("node"), "color").distinct().join(found, "node", "left_anti")
                frontier = written(back, "scc")
                found = found.unionAll(frontier)
            found = found.select("node", F.col("color").alias("component"))
            done = found if done is None else done.unionAll(found)
            left = written(left.join(found, "node", "left_anti"), "scc")
            edges = written(edges.join(left.select(F.col("node").alias("a")), "a", "left_semi").join(left.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"), "scc")
        return g.nodes.join(done, "node") if done is not None else g.nodes.select("node", F.col("node").alias("component"))

    # --- ranks
    def pagerank(self, damping: float = 0.85, max_iters: int = 20, tol: float = 1e-6) -> DataFrame:
        """node, rank; starts at 1/n, the rank of nodes without out-edges is spread evenly."""
        g = self.fixed()
        return _pagerank(g.nodes, g.edges.select("a", "b", F.lit(1.0).alias("w")), damping, max_iters, tol)

    # --- structure
    def undirected(self) -> DataFrame:
        """Distinct (lo, hi) without self-loops."""
        return self.edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()

    def triangle_count(self) -> int:
        """Triangles of the undirected graph; edges go from the end of lower degree, which bounds the fan-out by the square root of the edges."""
        und = written(self.undirected(), "undirected")
        degree = und.select(F.col("lo").alias("node")).unionAll(und.select("hi")).groupBy("node").agg(F.count("*").alias("d"))
        ranked = und.join(degree.select(F.col("node").alias("lo"), F.col("d").alias("dl")), "lo").join(degree.select(F.col("node").alias("hi"), F.col("d").alias("dh")), "hi")
        low_first = (F.col("dl") < F.col("dh")) | ((F.col("dl") == F.col("dh")) & (F.col("lo") < F.col("hi")))
        out = written(ranked.select(F.when(low_first, F.col("lo")).otherwise(F.col("hi")).alias("x"), F.when(low_first, F.col("hi")).otherwise(F.col("lo")).alias("y")), "oriented")
        wedge = out.join(out.select("x", F.col("y").alias("z")), "x").where("y < z").select("y", "z")
        return wedge.join(und.select(F.col("lo").alias("y"), F.col("hi").alias("z")), ["y", "z"]).count()

    def core_numbers(self) -> DataFrame:
        """node, core: every node takes the h-index of its neighbours' numbers until nothing changes."""
        g = self.fixed()
        und = g.undirected()
        both = written(und.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(und.select("hi", "lo")), "both")
        core = written(both.groupBy("u").agg(F.count("*").alias("core")), "core")
        while True:
            seen = both.join(core.select(F.col("u").alias("v"), "core"), "v").groupBy("u", "core").agg(F.count("*").alias("n"))
            ranked = seen.withColumn("above", F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("core"))))
            new = written(ranked.groupBy("u").agg(F.max(F.least("core", "above")).alias("core")), "core")
            same = new.join(core.withColumnRenamed("core", "old"), "u").where("core <> old").isEmpty()
            core = new
            if same:
                break
        return g.nodes.join(core, g.nodes["node"] == core["u"], "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))

    # --- centralities and communities: the edge list goes to each task
    def _arrays(self):
        """Nodes (sorted) and edges as numbers, after a check of the size."""
        import numpy as np

        g = self.fixed()
        if g.edges.count() > EXACT_EDGES:
            raise TooLarge(f"more than {EXACT_EDGES} edges")
        nodes = sorted(r[0] for r in g.nodes.collect())
        at = {n: i for i, n in enumerate(nodes)}
        pairs = np.array([(at[r[0]], at[r[1]]) for r in g.edges.collect()], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        starts = np.searchsorted(pairs[:, 0], np.arange(len(nodes) + 1))
        return nodes, pairs, starts

    def _per_source(self, work, schema: str, lots: int = 64) -> DataFrame:
        """Runs ``work(starts, targets, n, source) -> pandas frame`` for all sources, spread over tasks."""
        nodes, pairs, starts = self._arrays()
        spark, targets, n = self.edges.sparkSession, pairs[:, 1].copy(), len(nodes)

        def run(parts):
            import pandas as pd

            for part in parts:
                got = [work(starts, targets, n, int(s)) for s in part["id"]]
                if got:
                    yield pd.concat(got)

        index = spark.createDataFrame(list(enumerate(nodes)), "i long, node " + self.nodes.schema["node"].dataType.simpleString())
        return spark.range(n, numPartitions=max(1, min(lots, n))).mapInPandas(run, schema), index

    def betweenness(self) -> DataFrame:
        """node, betweenness: directed, unnormalised, end points excluded."""

        def work(starts, targets, n, s):
            import numpy as np
            import pandas as pd

            dist, paths, order = {s: 0}, {s: 1.0}, [s]
            before: dict = {s: []}
            for u in order:
                for v in targets[starts[u] : starts[u + 1]].tolist():
                    if v not in dist:
                        dist[v], paths[v], before[v] = dist[u] + 1, 0.0, []
                        order.append(v)
                    if dist[v] == dist[u] + 1:
                        paths[v] += paths[u]
                        before[v].append(u)
            share = np.zeros(n)
            for v in reversed(order[1:]):
                for u in before[v]:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
            share[s] = 0.0
            hit = np.flatnonzero(share)
            return pd.DataFrame({"i": hit, "x": share[hit]})

        parts, index = self._per_source(work, "i long, x double")
        return index.join(parts.groupBy("i").agg(F.sum("x").alias("x")), "i", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("betweenness"))

    def closeness(self) -> DataFrame:
        """node, closeness over out-edges: ((r-1)/S) * ((r-1)/(n-1)) for r reached nodes at total distance S."""

        def work(starts, targets, n, s):
            import pandas as pd

            dist, order = {s: 0}, [s]
            for u in order:
                for v in targets[starts[u] : starts[u + 1]].tolist():
                    if v not in dist:
                        dist[v] = dist[u] + 1
                        order.append(v)
            far, total = len(order) - 1, sum(dist.values())
            return pd.DataFrame({"i": [s], "x": [far / total * far / (n - 1) if total else 0.0]})

        parts, index = self._per_source(work, "i long, x double")
        return index.join(parts, "i").select("node", F.col("x").alias("closeness"))

    def louvain(self, directed: bool = False) -> DataFrame:
        """node, community (smallest node of it): local moving and aggregation until the modularity stops rising."""
        nodes, pairs, _ = self._arrays()
        label = louvain(len(nodes), pairs, directed)
        first: dict = {}
        for i, c in enumerate(label):
            first.setdefault(c, nodes[i])
        kind = self.nodes.schema["node"].dataType.simpleString()
        return self.edges.sparkSession.createDataFrame([(n, first[c]) for n, c in zip(nodes, label, strict=True)], f"node {kind}, community {kind}")


def louvain(n: int, pairs, directed: bool) -> list[int]:
    """Community numbers. Undirected: an edge weighs 1, a pair of opposite edges 2; a loop counts for its node.
    Directed: modularity with in- and out-strengths."""
    links: list[dict] = [{} for _ in range(n)]
    out, into = [0.0] * n, [0.0] * n
    for a, b in pairs.tolist():
        links[a][b] = links[a].get(b, 0.0) + 1.0
        if a != b:
            links[b][a] = links[b].get(a, 0.0) + 1.0
        out[a] += 1
        into[b] += 1
    total = float(len(pairs)) or 1.0
    member = list(range(n))
    while True:
        size = len(links)
        label = list(range(size))
        com_out, com_in = list(out), list(into)
        moved_any = True
        improved = False
        while moved_any:
            moved_any = False
            for i in range(size):
                here = label[i]
                com_out[here] -= out[i]
                com_in[here] -= into[i]
                weight: dict[int, float] = {here: 0.0}
                for j, w in links[i].items():
                    if j != i:
                        weight[label[j]] = weight.get(label[j], 0.0) + w

                def gain(c, i=i, weight=weight):
                    if directed:
                        return weight[c] / total - (out[i] * com_in[c] + into[i] * com_out[c]) / total**2
                    return weight[c] / total - (out[i] + into[i]) * (com_out[c] + com_in[c]) / (2 * total**2)

                best = max(sorted(weight), key=lambda c: (gain(c), c == here))
                if gain(best) <= gain(here) + 1e-12:
                    best = here
                com_out[best] += out[i]
                com_in[best] += into[i]
                if best != here:
                    label[i] = best
                    moved_any = improved = True
        names = {c: k for k, c in enumerate(sorted(set(label)))}
        member = [names[label[m]] for m in member]
        if not improved or len(names) == size:
            return member
        merged: list[dict] = [{} for _ in names]
        new_out, new_in = [0.0] * len(names), [0.0] * len(names)
        for i in range(size):
            c = names[label[i]]
            new_out[c] += out[i]
            new_in[c] += into[i]
            for j, w in links[i].items():
                d = names[label[j]]
                merged[c][d] = merged[c].get(d, 0.0) + w
        links, out, into = merged, new_out, new_in


def modularity(pairs, label, directed: bool) -> float:
    """Of a partition of a graph given by node numbers."""
    total = float(len(pairs)) or 1.0
    inside, out, into = 0.0, {}, {}
    for a, b in pairs.tolist():
        inside += label[a] == label[b]
        out[label[a]] = out.get(label[a], 0.0) + 1
        into[label[b]] = into.get(label[b], 0.0) + 1
    if directed:
        return inside / total - sum(out.get(c, 0) * into.get(c, 0) for c in out) / total**2
    return inside / total - sum(((out.get(c, 0) + into.get(c, 0)) / (2 * total)) ** 2 for c in {*out, *into})


def _pagerank(nodes: DataFrame, edges: DataFrame, damping: float, max_iters: int, tol: float) -> DataFrame:
    """edges: a, b, w. Rank is spread in proportion to w; a node without positive out-weight is dangling."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    total = edges.groupBy("a").agg(F.sum("w").alias("all")).where("all > 0")
    share = written(edges.join(total, "a").select("a", "b", (F.col("w") / F.col("all")).alias("share")), "share")
    rank = written(nodes.join(total.select(F.col("a").alias("node"), F.lit(True).alias("out")), "node", "left").select("node", F.coalesce("out", F.lit(False)).alias("out"), F.lit(1.0 / n).alias("rank")), "rank")
    lost = F.coalesce(F.sum(F.when(~F.col("out"), F.col("rank"))), F.lit(0.0))
    loose = rank.agg(lost).first()[0]
    for _ in range(max_iters):
        got = rank.select(F.col("node").alias("a"), "rank").join(share, "a").groupBy("b").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = rank.join(got, F.col("node") == F.col("b"), "left").select("node", "out", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"))
        last, rank = rank, written(new, "rank")
        discard(last)
        change, loose = rank.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), lost).first()  # of the last round, for the next one
        if change < tol:
            break
    return rank.select("node", "rank")


class WeightedGraph:
    """Edges (a, b, p, w), one for each (a, b, p)."""

    def __init__(self, edges: DataFrame):
        self.edges = edges.select("a", "b", "p", F.col("w").cast("double").alias("w")).dropDuplicates(["a", "b", "p"])
        self.nodes = self.edges.select(F.col("a").alias("node")).unionAll(self.edges.select("b")).distinct()

    @classmethod
    def of_triples(cls, triples: DataFrame, weight=None) -> WeightedGraph:
        """weight: a function (s, p, o columns) -> Column; 1 by default."""
        w = weight(F.col("s"), F.col("p"), F.col("o")) if weight else F.lit(1.0)
        return cls(triples.select(F.col("s").alias("a"), F.col("o").alias("b"), "p", w.alias("w")))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def _allowed(self, predicates) -> DataFrame:
        return self.edges if predicates is None else self.edges.where(F.col("p").isin(list(predicates)))

    def distances(self, source, predicates=None) -> DataFrame:
        """node, distance, parent from a source over non-negative weights: only nodes that got nearer go on."""
        best = written(self._allowed(predicates).groupBy("a", "b").agg(F.min("w").alias("w")), "weights")
        nodes = self.nodes
        kind = nodes.schema["node"].dataType
        dist = frontier = written(nodes.where(F.col("node") == source).select("node", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("parent")), "sssp")
        while not frontier.isEmpty():
            offer = frontier.select(F.col("node").alias("a"), "distance").join(best, "a").groupBy("b").agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("a").alias("via"))).alias("x"))
            both = dist.select("node", "distance", "parent").join(offer, F.col("node") == F.col("b"), "full_outer")
            nearer = F.col("x.d").isNotNull() & (F.col("distance").isNull() | (F.col("x.d") < F.col("distance")))
            now = written(both.select(F.coalesce("node", "b").alias("node"), F.when(nearer, F.col("x.d")).otherwise(F.col("distance")).alias("distance"), F.when(nearer, F.col("x.via")).otherwise(F.col("parent")).alias("parent"), nearer.alias("new")), "sssp")
            dist, frontier = now.drop("new"), now.where("new").drop("new")
        return dist

    def shortest_path(self, source, target, predicates=None) -> tuple[float, list] | None:
        if source == target:
            return (0.0, [source]) if not self.nodes.where(F.col("node") == source).isEmpty() else None
        dist = self.distances(source, predicates)
        hit = dist.where(F.col("node") == target).first()
        if hit is None:
            return None
        total, path, row = hit["distance"], [target], hit
        while row["parent"] is not None:
            path.append(row["parent"])
            row = dist.where(F.col("node") == row["parent"]).first()
        return total, path[::-1]

    def bfs(self, source, predicates) -> DataFrame:
        """node, hops over edges of the given predicates."""
        return Graph(self._allowed(predicates).select("a", "b"), self.nodes).bfs(source).select("node", "hops")

    def pagerank(self, damping: float = 0.85, max_iters: int = 20, tol: float = 1e-6) -> DataFrame:
        return _pagerank(self.nodes, self.edges.select("a", "b", "w"), damping, max_iters, tol)

    def topk_subgraph(self, pattern: list[tuple[str, object, str]], k: int, score=None) -> DataFrame:
        """The k best injective matches of a pattern of (variable, predicate or None, variable).

        Parallel edges count with their largest weight. Columns: the variables in
        order of appearance, and score, the sum of weights or ``score(weight columns)``.
        """
        names = list(dict.fromkeys(v for a, _, b in pattern for v in (a, b)))
        out, bound, weights = None, set(), []
        todo = list(enumerate(pattern))
        while todo:
            k_, (a, p, b) = todo.pop(next((i for i, (_, (x, _, y)) in enumerate(todo) if x in bound or y in bound), 0))
            e = self.edges if p is None else self.edges.where(F.col("p") == p)
            e = e.where("a <> b") if a != b else e.where("a = b")
            e = e.groupBy("a", "b").agg(F.max("w").alias(f"w{k_}_")).withColumnRenamed("a", f"{a}") if a != b else e.groupBy("a").agg(F.max("w").alias(f"w{k_}_")).withColumnRenamed("a", a)
            if a != b:
                e = e.withColumnRenamed("b", f"{b}")
            new = {a, b} - bound
            out = e if out is None else out.join(e, sorted({a, b} & bound)) if {a, b} & bound else out.crossJoin(e)
            for x in new:
                for y in bound | (new - {x}):
                    if y in bound or x < y:
                        out = out.where(F.col(x) != F.col(y))
            bound |= {a, b}
            weights.append(F.col(f"w{k_}_"))
        total = sum(weights[1:], weights[0]) if score is None else score(*weights)
        return out.select(*names, total.alias("score")).orderBy(F.desc("score"), *names).limit(k)

    def topk_subgraph_by(self, pattern, k: int, score) -> DataFrame:
        return self.topk_subgraph(pattern, k, score)

    #: The joins share their scans already, so the memoised variant is the same plan.
    topk_subgraph_memoized = topk_subgraph
