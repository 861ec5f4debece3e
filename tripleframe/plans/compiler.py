"""Algebra -> lazy DataFrames.

A ``Rel`` is a DataFrame whose columns hold the values of variables, with the
shape of each variable and whether it is certainly bound. Joins on certainly
bound variables are equi-joins; where a value may be unbound, each side is split
by what is bound and the parts meet in equi-joins. FILTERs of an OPTIONAL become its join
condition, EXISTS a correlated subquery that Catalyst turns into a semi or anti
join. Patterns with one subject over one table with a unique key become one scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.builtins import VOLATILE, Registry
from ..functions.values import Val
from ..terms import TYPE, from_nt, nt
from . import planner
from . import sparql as S


@dataclass
class Rel:
    df: DataFrame
    shapes: dict  # variable -> (shape, prefix or whole)
    certain: set
    names: dict  # variable -> column base name

    def val(self, var: str, suffix: str = "", wrap=None) -> Val:
        shape, extra = self.shapes[var]
        base = self.names[var]
        col = lambda c: (wrap or F.col)(f"{base}{c}{suffix}")
        if shape == "num":
            return Val("num", i=col("_i"), d=col("_d"), whole=extra)
        return Val(shape, col(""), prefix=extra if shape == "key" else "")

    def columns(self, var: str) -> list[str]:
        base = self.names[var]
        return [f"{base}_i", f"{base}_d"] if self.shapes[var][0] == "num" else [base]


def shape_of(v: Val) -> tuple:
    return (v.shape, v.prefix) if v.shape == "key" else (v.shape, v.whole) if v.shape == "num" else (v.shape, "")


def cells(v: Val, base: str) -> list[Column]:
    return [v.i.alias(f"{base}_i"), v.d.alias(f"{base}_d")] if v.shape == "num" else [v.col.alias(base)]


def subsets(names: list[str]) -> list[set[str]]:
    return [{v for k, v in enumerate(names) if bits >> k & 1} for bits in range(1 << len(names))]


def both(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


class Compiler:
    def __init__(self, spark: SparkSession, dataset, functions: Registry | None = None, transport=None, stats=None):
        self.spark, self.dataset = spark, dataset
        self.functions, self.transport, self.stats = functions or Registry(), transport, stats
        self.graph: tuple | None = None
        self.bases: dict[str, str] = {}
        self.prefix, self.depth = "v", 0

    # --- variables
    def base(self, var: str) -> str:
        return self.bases.setdefault(var, f"{self.prefix}{len(self.bases)}")

    def rel(self, df: DataFrame, vals: dict[str, Val], certain: set) -> Rel:
        """Selects the values of variables from a frame."""
        names = {v: self.base(v) for v in vals}
        return Rel(df.select(*[c for v, x in vals.items() for c in cells(x, names[v])]), {v: shape_of(x) for v, x in vals.items()}, set(certain), names)

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("unit_")), {}, set(), {})

    def nothing(self, names: list[str]) -> Rel:
        out = self.rel(self.spark.range(1), {v: V.null_val() for v in names}, set(names))
        out.df = out.df.limit(0)
        return out

    # --- patterns
    def pattern(self, p) -> Rel:
        if isinstance(p, S.Bgp):
            return self.bgp(p.triples)
        if isinstance(p, S.PathTriple):
            return self.path(p)
        if isinstance(p, S.Join):
            return self.joined(p.parts)
        if isinstance(p, S.LeftJoin):
            return self.left_join(self.pattern(p.left), self.pattern(p.right), p.filters)
        if isinstance(p, S.Union):
            return self.union([self.pattern(x) for x in p.parts])
        if isinstance(p, S.Minus):
            return self.minus(self.pattern(p.left), self.pattern(p.right))
        if isinstance(p, S.Filter):
            inner = self.pattern(p.inner)
            for test in p.tests:
                inner.df = inner.df.where(V.ebv(self.expr(test, inner)))
            return inner
        if isinstance(p, S.Extend):
            inner = self.pattern(p.inner)
            vals = {v: inner.val(v) for v in inner.shapes if v != p.var}
            return self.rel(inner.df, {**vals, p.var: self.expr(p.expr, inner)}, inner.certain - {p.var})
        if isinstance(p, S.Values):
            return self.values(p)
        if isinstance(p, S.SubSelect):
            return self.select(p.query)
        if isinstance(p, S.Graph):
            return self.in_graph(p)
        if isinstance(p, S.Service):
            return self.service(p)
        raise S.SparqlError(f"unknown pattern {type(p).__name__}")

    def joined(self, parts: list) -> Rel:
        """An n-ary join: smaller connected parts first is left to the order of patterns within a part."""
        flat: list = []
        triples: list = []
        for p in parts:
            for x in p.parts if isinstance(p, S.Join) else [p]:
                triples += x.triples if isinstance(x, S.Bgp) else []
                flat += [] if isinstance(x, S.Bgp) else [x]
        rels = ([self.bgp(triples)] if triples else []) + [self.pattern(x) for x in flat]
        if not rels:
            return self.unit()
        out = rels.pop(0)
        while rels:
            k = next((k for k, r in enumerate(rels) if r.shapes.keys() & out.shapes.keys()), 0)
            out = self.join(out, rels.pop(k))
        return out

    def values(self, p: S.Values) -> Rel:
        names = [f"c{k}" for k in range(len(p.vars))]
        columns = list(zip(*p.rows, strict=True)) if p.rows else [()] * len(names)
        vals = {}
        rows = [[None if t is None else nt(t) for t in row] for row in p.rows]
        for k, (var, column) in enumerate(zip(p.vars, columns, strict=True)):
            known = [V.const(t) for t in column if t is not None]
            shape = V.common(known) if known else ("nt", "")
            if shape[0] in ("iri", "str") and None not in column:
                for row, t in zip(rows, column, strict=True):
                    row[k] = t[1]
                vals[var] = Val(shape[0], F.col(names[k]))
            elif shape == ("num", True) and None not in column:
                for row, t in zip(rows, column, strict=True):
                    row[k] = str(int(t[1]))
                vals[var] = V.number(F.col(names[k]).cast("long"), F.col(names[k]).cast("double"), True)
            else:
                vals[var] = Val("nt", F.col(names[k]))
        # Through Arrow the rows are part of the plan, so parts of them that are empty fall out of it.
        df = self.spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names))
        return self.rel(df, vals, {v for v, c in zip(p.vars, columns, strict=True) if None not in c})

    # --- basic graph patterns
    def bgp(self, triples: list) -> Rel:
        if not triples:
            return self.unit()
        leaves = self.stars(triples) if hasattr(self.dataset, "props") else [[t] for t in triples]
        rels = [self.leaf(group) for group in leaves]
        if len(rels) == 1:
            return rels[0]
        return self.tree(planner.plan([self.estimate(k, group, rel) for k, (group, rel) in enumerate(zip(leaves, rels, strict=True))]), rels)

    def tree(self, node, rels: list[Rel]) -> Rel:
        return rels[node] if isinstance(node, int) else self.join(self.tree(node[0], rels), self.tree(node[1], rels))

    def estimate(self, number: int, group: list, rel: Rel) -> planner.Leaf:
        """Cardinality of a leaf: from predicate statistics if there are any, else by its constants."""
        s, p, o = group[0]
        known = self.stats() if callable(self.stats) else self.stats
        got = known.get(p[1]) if known and p[0] == "iri" else None
        rows, subjects, objects = got or (1e6, 1e6, 1e6)
        card = float(rows)
        if s[0] != "var":
            card /= max(subjects, 1)
        constants = sum(t[2][0] != "var" for t in group)
        card /= max(objects, 1) ** constants if got else 1e2**constants
        return planner.Leaf(number, max(card, 1.0), {v: max(min(card, subjects if s == ("var", v) else objects), 1.0) for v in rel.shapes})

    def stars(self, triples: list) -> list[list]:
        """Groups of triples with one subject whose predicates are columns of one table with a unique key."""
        groups: dict = {}
        for k, (s, p, o) in enumerate(triples):
            props = self.dataset.props.get(p[1], []) if p[0] == "iri" else []
            key = (s, props[0].table, props[0].subject) if len(props) == 1 and props[0].unique else ("single", k)
            groups.setdefault(key, []).append((s, p, o))
        tables = {key[0]: key for key in groups if key[0] != "single"}
        for key in list(groups):  # rdf:type with a class: read it with the star of its subject
            if key[0] == "single" and len(groups[key]) == 1:
                s, p, o = groups[key][0]
                if p == ("iri", TYPE) and o[0] == "iri" and s in tables:
                    of = [x for x in self.dataset.props.get(TYPE, []) if x.value == ("class", o[1])]
                    if len(of) == 1 and (of[0].table, of[0].subject) == tables[s][1:]:
                        groups[tables[s]].append(groups.pop(key)[0])
        return list(groups.values())

    def leaf(self, group: list) -> Rel:
        if not hasattr(self.dataset, "props"):
            return self.quad_leaf(*group[0])
        s, p, o = group[0]
        if self.graph is not None:
            return self.nothing(S.pattern_vars(S.Bgp(group)))
        if len(group) > 1:
            props = [self.prop_for(p, o) for _, p, o in group]
            return self.scan(props, group)
        predicates = [p[1]] if p[0] == "iri" else self.dataset.predicates() if p[0] == "var" else []
        arms = []
        for name in predicates:
            for prop in self.dataset.props.get(name, []):
                if prop.value[0] == "class" and o[0] != "var" and o != ("iri", prop.value[1]):
                    continue
                arms.append(self.scan([prop], group, name))
        if not arms:
            return self.nothing(S.pattern_vars(S.Bgp(group)))
        return arms[0] if len(arms) == 1 else self.union(arms)

    def prop_for(self, p: tuple, o: tuple):
        props = self.dataset.props[p[1]]
        return props[0] if len(props) == 1 else next(x for x in props if x.value == ("class", o[1]))

    def scan(self, props: list, group: list, predicate: str | None = None) -> Rel:
        """One scan of a table for all properties of one subject."""
        df = self.dataset.frame(props[0].table)
        if not props[0].unique:
            df = df.select(*dict.fromkeys(self.dataset.columns_of(props[0]))).distinct()
        vals: dict[str, Val] = {}
        tests: list[Column] = []

        def bind(term, val):
            if term[0] != "var":
                tests.append(V.same_term(val, V.const(term)))
            elif term[1] in vals:
                tests.append(V.same_term(vals[term[1]], val))
            else:
                vals[term[1]] = val

        for k, ((s, p, o), prop) in enumerate(zip(group, props, strict=True)):
            if k == 0:
                subject = self.dataset.subject_val(prop)
                tests.append(V.present(subject))
                bind(s, subject)
            if p[0] == "var":
                bind(p, Val("iri", F.lit(predicate), fixed=("iri", predicate)))
            value = self.dataset.object_val(prop)
            if prop.value[0] != "class":
                tests += [F.col(f"`{c}`").isNotNull() for c in self.dataset.columns_of(prop)[1:]]
            bind(o, value)
        return self.rel(df.where(both(tests)), {v: (Val(x.shape, x.col, prefix=x.prefix) if x.fixed else x) for v, x in vals.items()}, set(vals))

    def quad_leaf(self, s: tuple, p: tuple, o: tuple) -> Rel:
        df, terms = self.dataset.quads, [("s", s), ("p", p), ("o", o)]
        if self.graph is None:
            df = df.where(F.col("g").isNull())
        elif self.graph[0] == "var":
            df = df.where(F.col("g").isNotNull())
            terms.append(("g", self.graph))
        else:
            df = df.where(F.col("g") == nt(self.graph))
        if p[0] not in ("var", "iri"):
            return self.nothing(S.pattern_vars(S.Bgp([(s, p, o)])))
        vals: dict[str, Val] = {}
        for column, term in terms:
            if term[0] != "var":
                df = df.where(F.col(column) == nt(term))
            elif term[1] in vals:
                df = df.where(vals[term[1]].col == F.col(column))
            else:
                vals[term[1]] = Val("nt", F.col(column))
        return self.rel(df, vals, set(vals)) if vals else Rel(df.select(F.lit(1).alias("unit_")), {}, set(), {})

    # --- joins
    def aligned(self, left: Rel, right: Rel) -> tuple[Rel, Rel, list[str]]:
        """Both sides with shared variables in one shape each."""
        shared = [v for v in left.shapes if v in right.shapes]
        want = {}
        for v in shared:
            shape = V.common([left.val(v), right.val(v)])
            want[v] = ("nt", "") if shape[0] == "num" and shape[1] is not True else shape

        def fit(rel):
            if all(rel.shapes[v] == want[v] for v in shared):
                return rel
            return self.rel(rel.df, {v: V.reshape(rel.val(v), want[v]) if v in want else rel.val(v) for v in rel.shapes}, rel.certain)

        return fit(left), fit(right), shared

    def condition(self, left: Rel, right: Rel, shared: list[str]) -> tuple[DataFrame, Column]:
        """The right frame with shared columns renamed, and the compatibility test."""
        df, tests = right.df, []
        for v in shared:
            for c in right.columns(v):
                df = df.withColumnRenamed(c, f"{c}__r")
        for v in shared:
            a, b = left.columns(v)[0], f"{right.columns(v)[0]}__r"
            same = F.col(a) == F.col(b)
            if v not in left.certain:
                same = same | F.col(a).isNull()
            if v not in right.certain:
                same = same | F.col(b).isNull()
            tests.append(same)
        return df, both(tests)

    def merged(self, df: DataFrame, left: Rel, right: Rel, shared: list[str], certain: set) -> Rel:
        cols = []
        for v in left.shapes:
            for c in left.columns(v):
                cols.append(F.coalesce(F.col(c), F.col(f"{c}__r")).alias(c) if v in shared and v not in left.certain else F.col(c))
        cols += [F.col(c) for v in right.shapes if v not in left.shapes for c in right.columns(v)]
        shapes = {**right.shapes, **left.shapes}
        order = {v: shapes[v] for v in [*left.shapes, *(v for v in right.shapes if v not in left.shapes)]}
        return Rel(df.select(*cols) if cols else df.select(F.lit(1).alias("unit_")), order, certain, {v: self.base(v) for v in order})

    def join(self, left: Rel, right: Rel) -> Rel:
        if not left.shapes and "unit_" in left.df.columns and not right.shapes:
            return Rel(left.df.crossJoin(right.df.drop("unit_")).select("unit_") if right.df.columns != ["unit_"] else left.df.crossJoin(right.df.withColumnRenamed("unit_", "u2")).select("unit_"), {}, set(), {})
        left, right, shared = self.aligned(left, right)
        certain = left.certain | right.certain
        if not shared:
            df = left.df.crossJoin(right.df.drop("unit_") if right.shapes else right.df.withColumnRenamed("unit_", "unit2_"))
            return self.merged(df, left, right, [], certain)
        if all(v in left.certain and v in right.certain for v in shared):
            keys = [c for v in shared for c in left.columns(v)[:1]]
            extra = [c for v in shared for c in right.columns(v)[1:]]
            return self.merged(left.df.join(right.df.drop(*extra), keys), left, right, [], certain)
        return self.merged(self.compatible(left, right, shared, "inner"), left, right, shared, certain)

    def compatible(self, left: Rel, right: Rel, shared: list[str], how: str, filters: Column | None = None) -> DataFrame:
        """Rows of both sides that agree on every shared variable bound on both.

        Which of the variables that may be unbound are bound splits each side into parts; two
        parts meet in a join on the keys that both bind, so there is no "unbound or equal" test.
        With more than three such variables the rest stays in the condition. Parts without a
        common key (all values unbound on one side) meet in a product, as they must. how:
        inner, left_anti, or left where the right side has one part.
        """
        free = [v for v in shared if v not in left.certain or v not in right.certain][:3]
        other, test = self.condition(left, right, [v for v in shared if v not in free])
        for v in free:
            for c in right.columns(v):
                other = other.withColumnRenamed(c, f"{c}__r")
        if filters is not None:
            test = test & filters
        a = {v: F.col(left.columns(v)[0]) for v in free}
        b = {v: F.col(f"{right.columns(v)[0]}__r") for v in free}

        def part(df, columns, bound, loose):
            return df.where(both([columns[v].isNotNull() if v in bound else columns[v].isNull() for v in loose]))

        loose_left, loose_right = ([v for v in free if v not in side.certain] for side in (left, right))
        out = []
        for bound_left in subsets(loose_left):
            mine = part(left.df, a, bound_left, loose_left)
            for bound_right in subsets(loose_right):
                keys = [v for v in free if (v in bound_left or v not in loose_left) and (v in bound_right or v not in loose_right)]
                theirs = part(other, b, bound_right, loose_right)
                match = both([*(a[v] == b[v] for v in keys), test])
                if how != "left_anti":
                    out.append(mine.join(theirs, match, how))
                elif keys or len(free) < len(shared):  # else nothing in common: MINUS keeps the row
                    mine = mine.join(theirs, match, "left_anti")
            if how == "left_anti":
                out.append(mine)
        return reduce(lambda x, y: x.unionByName(y), out)

    def left_join(self, left: Rel, right: Rel, filters: list) -> Rel:
        left, right, shared = self.aligned(left, right)
        df, test = self.condition(left, right, shared)
        if not right.shapes:
            df = df.withColumnRenamed("unit_", "unit2_")
        if filters:
            whole = Rel(left.df, {**right.shapes, **left.shapes}, left.certain | right.certain, {v: self.base(v) for v in {**right.shapes, **left.shapes}})

            def see(var):
                if var in left.shapes and var in shared and var not in left.certain:
                    return coalesced(left.val(var), right.val(var, "__r"))
                return left.val(var) if var in left.shapes else right.val(var)

            filters = [V.ebv(self.expr(f, whole, see)) for f in filters]
        if all(v in left.certain for v in shared) or not all(v in right.certain for v in shared):
            return self.merged(left.df.join(df, both([test, *filters]), "left"), left, right, shared, set(left.certain))
        return self.merged(self.compatible(left, right, shared, "left", both(filters) if filters else None), left, right, shared, set(left.certain))

    def minus(self, left: Rel, right: Rel) -> Rel:
        left, right, shared = self.aligned(left, right)
        if not shared:
            return left
        df, test = self.condition(left, right, shared)
        if all(v in left.certain and v in right.certain for v in shared):
            return Rel(left.df.join(df, test, "left_anti"), left.shapes, left.certain, left.names)
        loose = [v for v in shared if v not in left.certain or v not in right.certain]
        if len(loose) > 3:  # a part may lack a common key but for the variables left in the condition
            if not any(v in left.certain and v in right.certain for v in shared):
                some = [F.col(left.columns(v)[0]).isNotNull() & F.col(f"{right.columns(v)[0]}__r").isNotNull() for v in shared]
                test = test & reduce(lambda a, b: a | b, some)
            return Rel(left.df.join(df, test, "left_anti"), left.shapes, left.certain, left.names)
        return Rel(self.compatible(left, right, shared, "left_anti").select(*left.df.columns), left.shapes, left.certain, left.names)

    def union(self, rels: list[Rel]) -> Rel:
        names = list(dict.fromkeys(v for r in rels for v in r.shapes))
        if not names:
            return Rel(reduce(lambda a, b: a.unionAll(b), [r.df.select(F.lit(1).alias("unit_")) for r in rels]), {}, set(), {})
        shapes = {}
        for v in names:
            shape = V.common([r.val(v) for r in rels if v in r.shapes])
            shapes[v] = shape
        frames = []
        for r in rels:
            vals = {}
            for v in names:
                if v in r.shapes:
                    vals[v] = V.reshape(r.val(v), shapes[v])
                elif shapes[v][0] == "num":
                    vals[v] = V.number(F.lit(None).cast("long"), F.lit(None).cast("double"), shapes[v][1])
                else:
                    like = next(x for x in rels if v in x.shapes)
                    kind = V.reshape(like.val(v), shapes[v])
                    vals[v] = Val(kind.shape, F.lit(None).cast(like.df.select(kind.col.alias("x")).schema["x"].dataType), prefix=kind.prefix)
            frames.append(self.rel(r.df, vals, r.certain))
        out = frames[0]
        out.df = reduce(lambda a, b: a.unionByName(b), [f.df for f in frames])
        out.certain = {v for v in names if all(v in r.certain for r in rels)}
        return out

    # --- graphs and services
    def in_graph(self, p: S.Graph) -> Rel:
        before, self.graph = self.graph, p.name
        try:
            if p.name[0] != "var" or not has_path(p.inner):
                out = self.pattern(p.inner)
                if p.name[0] == "var" and p.name[1] not in out.shapes and hasattr(self.dataset, "quads"):
                    names = self.dataset.quads.where(F.col("g").isNotNull()).select("g").distinct()
                    out = self.join(out, self.rel(names, {p.name[1]: Val("nt", F.col("g"))}, {p.name[1]}))
                return out
            arms = []
            for row in self.dataset.quads.where(F.col("g").isNotNull()).select("g").distinct().toLocalIterator():
                self.graph = from_nt(row["g"])
                inner = self.pattern(p.inner)
                vals = {v: inner.val(v) for v in inner.shapes}
                arms.append(self.join(inner, self.rel(self.spark.range(1), {p.name[1]: Val("nt", F.lit(row["g"]))}, {p.name[1]})) if p.name[1] in vals else self.rel(inner.df, {**vals, p.name[1]: Val("nt", F.lit(row["g"]))}, inner.certain | {p.name[1]}))
            return self.union(arms) if arms else self.nothing(S.pattern_vars(p))
        finally:
            self.graph = before

    def service(self, p: S.Service) -> Rel:
        """Solutions of a remote endpoint, fetched by the transport: query text -> rows of terms by variable."""
        names = S.pattern_vars(p.inner)
        shippable = isinstance(p.inner, (S.Bgp, S.Join, S.Union)) and p.endpoint[0] == "iri"
        try:
            if not shippable:
                raise S.SparqlError("this pattern can't be sent to a service")
            if self.transport is None:
                from ..sources.results import http_service

                self.transport = http_service
            rows = self.transport(p.endpoint[1], "SELECT * WHERE " + p.text)
        except Exception:  # a failing service gives no rows, or one empty row if SILENT
            return self.unit() if p.silent else self.nothing(names)
        table = [tuple(None if r.get(v) is None else nt(r[v]) for v in names) for r in rows]
        df = self.spark.createDataFrame(table, ", ".join(f"c{k} string" for k in range(len(names))) or "x string")
        unbound = {v for k, v in enumerate(names) if any(r[k] is None for r in table)}
        return self.rel(df, {v: Val("nt", F.col(f"c{k}")) for k, v in enumerate(names)}, set(names) - unbound)

    def path(self, p: S.PathTriple) -> Rel:
        from ..operators.paths import Paths

        end = lambda t: None if t[0] == "var" else nt(t)
        pairs = Paths(self).pairs(p.path, end(p.subject), end(p.object))
        vals: dict[str, Val] = {}
        for column, term in (("a", p.subject), ("b", p.object)):
            if term[0] != "var":
                pairs = pairs.where(F.col(column) == nt(term))
            elif term[1] in vals:
                pairs = pairs.where(F.col("a") == F.col("b"))
            else:
                vals[term[1]] = Val("nt", F.col(column))
        return self.rel(pairs, vals, set(vals)) if vals else Rel(pairs.limit(1).select(F.lit(1).alias("unit_")), {}, set(), {})

    def steps(self, predicate: str) -> DataFrame:
        """Distinct pairs (a, b) of a predicate, as canonical strings."""
        if hasattr(self.dataset, "quads"):
            df = self.dataset.quads.where(F.col("p") == f"<{predicate}>")
            df = df.where(F.col("g").isNull() if self.graph is None else F.col("g") == nt(self.graph))
            return df.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
        rel = self.leaf([(("var", " s"), ("iri", predicate), ("var", " o"))])
        return rel.df.select(V.to_nt(rel.val(" s")).alias("a"), V.to_nt(rel.val(" o")).alias("b")).distinct()

    def triples(self) -> DataFrame:
        """All triples of the active graph: s, p, o as canonical strings."""
        if hasattr(self.dataset, "quads"):
            df = self.dataset.quads.where(F.col("g").isNull() if self.graph is None else F.col("g") == nt(self.graph))
            return df.select("s", "p", "o")
        rel = self.leaf([(("var", " s"), ("var", " p"), ("var", " o"))])
        return rel.df.select(*[V.to_nt(rel.val(f" {x}")).alias(x) for x in "spo"])

    # --- expressions
    def expr(self, e: tuple, rel: Rel, see=None) -> Val:
        see = see or (lambda v: rel.val(v) if v in rel.shapes else V.null_val())
        head = e[0]
        if head == "var":
            try:
                return see(e[1])
            except KeyError:
                return V.null_val()
        if head == "const":
            return V.const(e[1])
        again = lambda x: self.expr(x, rel, see)
        if head in ("or", "and"):
            a, b = V.ebv(again(e[1])), V.ebv(again(e[2]))
            return Val("bool", a | b if head == "or" else a & b)
        if head == "not":
            return Val("bool", ~V.ebv(again(e[1])))
        if head == "cmp":
            return Val("bool", V.compare(e[1], again(e[2]), again(e[3])))
        if head == "arith":
            return V.arithmetic(e[1], again(e[2]), again(e[3]))
        if head == "neg":
            return V.negate(again(e[1]))
        if head == "exists":
            got = self.exists(e[2], rel, see)
            return Val("bool", ~got if e[1] else got)
        if head == "call":
            return self.call(e[1], e[2], again)
        raise S.SparqlError(f"an aggregate is not allowed here: {e[1]}")

    def call(self, name: str, args: list, again) -> Val:
        if name == "BOUND":
            return Val("bool", V.present(again(args[0])))
        if name in ("CYCLEBOOLEAN", "SIMPLECYCLEBOOLEAN", "SHORTESTPATHLEN", "KHOPREACHABLE"):
            from ..operators.paths import graph_function

            return graph_function(self, name, [again(a) for a in args])
        build = self.functions.find(name)
        if build is None:
            return V.null_val()
        try:
            return build(*[again(a) for a in args])
        except TypeError as x:
            if "argument" in str(x):
                return V.null_val()
            raise

    def exists(self, pattern, rel: Rel, see) -> Column:
        """A correlated subquery. FILTERs at the top of the inner group that read outer variables are part of the condition."""
        before = self.bases, self.prefix
        self.depth += 1
        self.bases, self.prefix = {}, f"e{self.depth}x"  # an outer name must not occur inside, it would be taken for an inner column
        try:
            tests = []
            own = self.pattern(pattern.inner if isinstance(pattern, S.Filter) else pattern)
            for t in pattern.tests if isinstance(pattern, S.Filter) else []:
                if t[0] != "exists" and S.expr_vars(t) <= own.shapes.keys():
                    own.df = own.df.where(V.ebv(self.expr(t, own)))
                else:
                    tests.append(t)
        finally:
            self.bases, self.prefix = before
        shared = [v for v in rel.shapes if v in own.shapes]
        outer = lambda v: rel.val(v, wrap=lambda c: F.col(c).outer())
        conditions = []
        for v in shared:
            a, b = outer(v), own.val(v)
            same = V.same_term(a, b)
            if v not in rel.certain:
                same = same | ~V.present(a)
            if v not in own.certain:
                same = same | ~V.present(b)
            conditions.append(same)
        for t in tests:
            conditions.append(V.ebv(self.expr(t, own, lambda v: own.val(v) if v in own.shapes else outer(v) if v in rel.shapes else V.null_val())))
        return own.df.where(both(conditions)).exists()

    # --- SELECT
    def select(self, q: S.Select) -> Rel:
        """Solutions of a query: projected, ordered, distinct, sliced."""
        rel = self.pattern(q.where)
        if q.items is None and q.group:
            raise S.SparqlError("SELECT * can't be used with GROUP BY")
        items = q.items if q.items is not None else [(v, None) for v in S.pattern_vars(q.where)]
        grouped = bool(q.group) or any(has_aggregate(e) for _, e in items if e) or any(map(has_aggregate, [*q.having, *[e for e, _ in q.order]]))
        if grouped:
            rel, see = self.grouped(q, rel, items)
        else:
            see = lambda v: rel.val(v) if v in rel.shapes else V.null_val()
            for test in q.having:
                rel.df = rel.df.where(V.ebv(self.expr(test, rel, see)))
        ev = lambda e: self.value(e, rel, see)
        vals = {v: ev(e) if e else see(v) for v, e in items}
        keys = []
        for k, (e, down) in enumerate(q.order):
            own = vals[e[1]] if e[0] == "var" and e[1] in vals else ev(e)
            keys.append((f"o{k}_", V.order_struct(own), down))
        names = {v: self.base(v) for v in vals}
        flat = [c for v, x in vals.items() for c in cells(x, names[v])]
        df = rel.df.select(*flat, *[c.alias(n) for n, c, _ in keys])
        plain = [c for v, x in vals.items() for c in ([f"{names[v]}_i", f"{names[v]}_d"] if x.shape == "num" else [names[v]])]
        if q.distinct:
            df = df.dropDuplicates(plain) if keys else df.distinct()
        if keys:
            df = df.orderBy(*[F.desc(n) if down else F.asc(n) for n, _, down in keys])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        certain = {v for v, e in items if e is None and v in rel.certain}
        return Rel(df.select(*plain), {v: shape_of(x) for v, x in vals.items()}, certain, names)

    def value(self, e: tuple, rel: Rel, see) -> Val:
        """An expression whose aggregates are already columns of the grouped frame."""
        if e[0] == "agg":
            return self.hidden[repr(e)]
        if not has_aggregate(e):
            known = self.keys.get(repr(e)) if getattr(self, "keys", None) else None
            return known or self.expr(e, rel, see)
        head, again = e[0], (lambda x: self.value(x, rel, see))
        if head in ("or", "and"):
            a, b = V.ebv(again(e[1])), V.ebv(again(e[2]))
            strict = a | b if head == "or" else a & b
            return Val("bool", F.when(a.isNotNull() & b.isNotNull(), strict))
        if head == "not":
            return Val("bool", ~V.ebv(again(e[1])))
        if head == "cmp":
            return Val("bool", V.compare(e[1], again(e[2]), again(e[3])))
        if head == "arith":
            return V.arithmetic(e[1], again(e[2]), again(e[3]))
        if head == "neg":
            return V.negate(again(e[1]))
        return self.call(e[1], e[2], again)

    def grouped(self, q: S.Select, rel: Rel, items: list):
        keys = {f"k{k}_": (e, alias, self.expr(e, rel)) for k, (e, alias) in enumerate(q.group)}
        aggregates: dict[str, tuple] = {}
        for e in [e for _, e in items if e] + q.having + [e for e, _ in q.order]:
            collect_aggregates(e, aggregates)
        out, self.hidden = [], {}
        for k, (text, e) in enumerate(aggregates.items()):
            columns, val = aggregate(e, lambda x: self.expr(x, rel), rel, f"a{k}_")
            out += columns
            self.hidden[text] = val
        keyed = {e[1] for e, _, _ in keys.values() if e[0] == "var"}
        read = {v for v, e in items if e is None} | set().union(*[loose_vars(e) for e in [e for _, e in items if e] + q.having + [e for e, _ in q.order]], set())
        loose = [v for v in read if v in rel.shapes and v not in keyed]
        out += [F.first(c).alias(f"f_{c}") for v in loose for c in rel.columns(v)]
        flat = [c for n, (_, _, x) in keys.items() for c in cells(x, n)]
        plain = [c for n, (_, _, x) in keys.items() for c in ([f"{n}_i", f"{n}_d"] if x.shape == "num" else [n])]
        source = rel.df.select(*rel.df.columns, *flat)
        out = out or [F.count(F.lit(1)).alias("a_")]
        df = source.groupBy(*plain).agg(*out) if keys else source.agg(*out)
        whole = Rel(df, {}, set(), {})
        vals: dict[str, Val] = {v: Rel(df, {v: rel.shapes[v]}, set(), {v: f"f_{rel.names[v]}"}).val(v) for v in loose}
        self.keys = {}
        for n, (e, alias, x) in keys.items():
            got = Rel(df, {n: shape_of(x)}, set(), {n: n}).val(n)
            self.keys[repr(e)] = got
            for name in [e[1]] if e[0] == "var" else [alias] if alias else []:
                vals[name] = got
                if name in rel.certain:
                    whole.certain.add(name)
        see = lambda v: vals.get(v) or V.null_val()
        for test in q.having:
            whole.df = whole.df.where(V.ebv(self.value(test, whole, see)))
        return whole, see

    # --- results
    def decoded(self, rel: Rel, order: list[str], decode: str) -> DataFrame:
        """Result columns: native types, or canonical N-Triples strings."""
        return rel.df.select(*[(V.to_nt(rel.val(v)) if decode == "ntriples" else native(rel.val(v))).alias(v) for v in order])


def native(v: Val) -> Column:
    if v.shape == "num":
        return v.i if v.whole else V.num_of(v)
    if v.shape in ("bool", "time", "str"):
        return v.col
    return V.raw_lexical(v)


def coalesced(a: Val, b: Val) -> Val:
    if a.shape == "num":
        return V.number(F.coalesce(a.i, b.i), F.coalesce(a.d, b.d), a.whole)
    return Val(a.shape, F.coalesce(a.col, b.col), prefix=a.prefix)


def has_aggregate(e: tuple) -> bool:
    if e[0] == "agg":
        return True
    if e[0] == "exists":
        return False
    return any(has_aggregate(y) for x in e[1:] for y in (x if isinstance(x, list) else [x]) if isinstance(y, tuple) and y and isinstance(y[0], str))


def collect_aggregates(e: tuple, out: dict) -> None:
    if e[0] == "agg":
        out[repr(e)] = e
    elif e[0] != "exists":
        for x in e[1:]:
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, tuple) and y and isinstance(y[0], str):
                    collect_aggregates(y, out)


def loose_vars(e: tuple) -> set[str]:
    """Variables read outside aggregates."""
    if e[0] == "agg":
        return set()
    if e[0] == "var":
        return {e[1]}
    out: set[str] = set()
    for x in e[1:]:
        for y in x if isinstance(x, list) else [x]:
            if isinstance(y, tuple) and y and isinstance(y[0], str) and y[0] not in ("iri", "lit", "blank"):
                out |= loose_vars(y)
    return out


def has_path(p) -> bool:
    if isinstance(p, S.PathTriple):
        return True
    return any(has_path(x) for a in vars(p).values() for x in (a if isinstance(a, list) else [a]) if hasattr(x, "__dataclass_fields__"))


def is_volatile(text: str) -> bool:
    upper = text.upper()
    return any(f"{name}(" in upper.replace(" ", "") for name in VOLATILE)


def aggregate(e: tuple, ev, rel: Rel, name: str) -> tuple[list[Column], Val]:
    """Columns of ``agg`` for an aggregate, and its value over them."""
    _, kind, distinct, arg, separator = e
    if arg is None:
        every = F.struct(*[F.col(c) for v in rel.shapes for c in rel.columns(v)]) if rel.shapes else F.lit(1)
        n = F.count_distinct(every) if distinct else F.count(F.lit(1))
        return [n.alias(name)], V.number(F.col(name), F.col(name).cast("double"), True)
    v = ev(arg)
    one = V.to_nt(v) if v.shape in ("nt", "num") and v.whole is not True else v.i if v.shape == "num" else v.col
    if kind == "COUNT":
        n = F.count_distinct(one) if distinct else F.count(one)
        return [n.alias(name)], V.number(F.col(name), F.col(name).cast("double"), True)
    i, d = V.int_of(v), V.num_of(v)
    if kind in ("SUM", "AVG"):
        if distinct and v.whole is not True:
            pick = F.collect_set(F.struct(one.alias("t"), i.alias("i"), d.alias("d")))
            got = F.filter(pick, lambda x: x["t"].isNotNull())
            total_d = F.aggregate(got, F.lit(0.0), lambda a, x: a + F.coalesce(x["d"], F.lit(0.0)))
            total_i = F.aggregate(got, F.lit(0).cast("long"), lambda a, x: F.try_add(a, F.coalesce(x["i"], F.lit(0).cast("long"))))
            columns = [total_i.alias(f"{name}i"), total_d.alias(f"{name}d"), F.size(got).cast("long").alias(f"{name}n"), F.size(F.filter(got, lambda x: x["i"].isNull() & x["d"].isNotNull())).alias(f"{name}f")]
        elif distinct:
            columns = [F.sum_distinct(i).alias(f"{name}i"), F.sum_distinct(d).alias(f"{name}d"), F.count_distinct(i).alias(f"{name}n"), F.lit(0).alias(f"{name}f")]
            columns[-1] = F.count(F.lit(None).cast("int")).alias(f"{name}f")
        else:
            columns = [F.try_sum(i).alias(f"{name}i"), F.sum(d).alias(f"{name}d"), F.count(one).alias(f"{name}n"), F.count(F.when(i.isNull() & d.isNotNull(), 1)).alias(f"{name}f")]
        si, sd, n, floats = (F.col(f"{name}{x}") for x in "idnf")
        if kind == "SUM":
            whole = F.when(floats == 0, F.when(sd.isNull(), F.lit(0).cast("long")).otherwise(si))
            return columns, V.number(whole, F.coalesce(sd, F.lit(0.0)), "wide" if v.whole else False)
        return columns, V.number(F.when(n == 0, F.lit(0).cast("long")), F.when(n == 0, 0.0).otherwise(F.coalesce(sd, F.lit(0.0)) / n))
    if kind in ("MIN", "MAX"):
        f = F.min if kind == "MIN" else F.max
        if v.shape == "nt":
            return [f(F.when(v.col.isNotNull(), F.struct(V.order_struct(v).alias("k"), v.col.alias("v")))).alias(name)], Val("nt", F.col(name)["v"])
        if v.shape == "num":
            return [f(i).alias(f"{name}i"), f(d).alias(f"{name}d")], V.number(F.when(F.col(f"{name}i").cast("double") == F.col(f"{name}d"), F.col(f"{name}i")), F.col(f"{name}d"), v.whole)
        return [f(v.col).alias(name)], Val(v.shape, F.col(name), prefix=v.prefix)
    if kind == "SAMPLE":
        if v.shape == "num":
            pick = F.first(F.when(V.present(v), F.struct(v.i.alias("i"), v.d.alias("d"))), ignorenulls=True)
            return [pick.alias(name)], V.number(F.col(name)["i"], F.col(name)["d"], v.whole)
        return [F.first(v.col, ignorenulls=True).alias(name)], Val(v.shape, F.col(name), prefix=v.prefix)
    text = V.lexical(v)
    texts = F.sort_array(F.collect_set(text) if distinct else F.collect_list(text))
    return [F.array_join(texts, separator).alias(name)], Val("str", F.col(name))
