"""A versioned quad store: a base table and delta tables, SPARQL on any version.

A version is the base with the deltas up to it; a delta holds (op, g, s, p, o) rows
of effective changes only, so a state is base union adds minus removes per delta,
oldest first. Rollback drops versions, readers keep the plan of theirs, time travel
picks an older one, and the update and redo logs are these deltas plus the texts.
"""

from __future__ import annotations

import json
import re
import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.builtins import Registry
from .plans import sparql as S
from .plans.compiler import Compiler, is_volatile
from .storage import written
from .terms import RDFS, TYPE, nt

QUADS = "g string, s string, p string, o string"
KEY = ["g", "s", "p", "o"]
#: Deltas after which a version is written as a new base.
COMPACT = 16


class StoreError(RuntimeError):
    """A transaction or snapshot can't do what was asked."""


class Conflict(StoreError):
    """Another transaction changed what this one wrote or read."""


@dataclass
class Quads:
    """One version as a dataset for the compiler."""

    quads: DataFrame
    stats_cache: dict | None = None

    def stats(self) -> dict:
        """predicate IRI -> (triples, distinct subjects, distinct objects), of the default graph."""
        if self.stats_cache is None:
            rows = predicate_stats(self.quads.where("g is null")).collect()
            self.stats_cache = {r["p"][1:-1]: (r["triples"], r["subjects"], r["objects"]) for r in rows}
        return self.stats_cache


def predicate_stats(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count("*").alias("triples"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))


@dataclass
class Answer:
    """select: a frame; ask: a bool; construct: a frame s, p, o; update: the number of changes."""

    kind: str
    value: object


@dataclass
class Version:
    number: int
    data: Quads
    deltas: int
    written_keys: frozenset | None  # keys of the changed quads, None if unknown or too many


class Engine:
    """SPARQL over a read-only dataset (a ``Mapping`` or ``Quads``)."""

    def __init__(self, spark: SparkSession, dataset, functions: Registry | None = None, transport=None):
        self.spark, self.dataset, self.transport = spark, dataset, transport
        self.functions = functions or Registry()

    def compiler(self) -> Compiler:
        return Compiler(self.spark, self.dataset, self.functions, self.transport, getattr(self.dataset, "stats_cache", None))

    def register_function(self, name: str, build) -> None:
        self.functions.register(name, build)

    def register_udf(self, name: str, function, returns: str = "string") -> None:
        self.functions.register_udf(name, function, returns)

    def query(self, text: str, decode: str = "native") -> Answer:
        return self.run(S.parse(text), decode)

    def run(self, request, decode: str = "native") -> Answer:
        c = self.compiler()
        if isinstance(request, S.Select):
            if request.items is None and request.group:
                raise S.SparqlError("SELECT * can't be used with GROUP BY")
            rel = c.select(request)
            names = [v for v, _ in request.items] if request.items is not None else S.pattern_vars(request.where)
            return Answer("select", c.decoded(rel, names, decode))
        if isinstance(request, S.Ask):
            return Answer("ask", not c.pattern(request.where).df.limit(1).isEmpty())
        if isinstance(request, S.Construct):
            return Answer("construct", self.instantiate(c, [t[:3] for t in request.template], c.select(request.query)).distinct())
        if isinstance(request, S.Describe):
            return Answer("construct", self.describe(c, request))
        raise S.SparqlError("updates need a Store")

    def select(self, text: str, decode: str = "native") -> DataFrame:
        answer = self.query(text, decode)
        if answer.kind != "select":
            raise S.SparqlError("not a SELECT")
        return answer.value

    def ask(self, text: str) -> bool:
        return self.query(text).value

    def ask_frame(self, text: str) -> DataFrame:
        """ASK as a lazy one-row frame: answer."""
        c = self.compiler()
        return c.pattern(S.parse(text).where).df.limit(1).agg((F.count("*") > 0).alias("answer"))

    def construct(self, text: str) -> DataFrame:
        return self.query(text).value

    @staticmethod
    def instantiate(c: Compiler, template: list, rel) -> DataFrame:
        """Triples of a template, one select a triple; those with an unbound variable are left out."""
        from .functions import values as V

        out = None
        for triple in template:
            columns = [V.to_nt(rel.val(t[1])) if t[0] == "var" and t[1] in rel.shapes else F.lit(None).cast("string") if t[0] == "var" else F.lit(nt(t)) for t in triple]
            part = rel.df.select(*[x.alias(n) for x, n in zip(columns, "spo", strict=True)]).dropna()
            out = part if out is None else out.unionAll(part)
        return c.spark.createDataFrame([], "s string, p string, o string") if out is None else out

    def describe(self, c: Compiler, d: S.Describe) -> DataFrame:
        """Outgoing triples of the resources."""
        from .functions import values as V

        targets = None
        rel = c.select(d.query) if d.query else None
        for t in d.targets if d.targets is not None else [("var", v) for v in (rel.shapes if rel else [])]:
            if t[0] == "var":
                if rel is None or t[1] not in rel.shapes:
                    continue
                part = rel.df.select(V.to_nt(rel.val(t[1])).alias("s"))
            else:
                part = c.spark.createDataFrame([(nt(t),)], "s string")
            targets = part if targets is None else targets.unionAll(part)
        if targets is None:
            return c.spark.createDataFrame([], "s string, p string, o string")
        return c.triples().join(targets.distinct(), "s", "left_semi").select("s", "p", "o").distinct()


class Store:
    """A mutable store; one writer at a time, any number of pinned readers."""

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, functions: Registry | None = None, transport=None, cache: int = 256):
        self.spark, self.functions, self.transport = spark, functions or Registry(), transport
        base = spark.createDataFrame([], QUADS) if quads is None else quads.select(*KEY).distinct()
        self.versions = [Version(1, Quads(written(base, "quads")), 0, frozenset())]
        self.open_at: int | None = None
        self.pending: list = []
        self.cache: OrderedDict = OrderedDict()
        self.cache_size = cache
        self.rules: OrderedDict = OrderedDict()
        self.update_log: list | None = None
        self.redo_log: list | None = None

    # --- building
    @classmethod
    def from_text(cls, spark: SparkSession, text: str, fmt: str = "turtle", **more) -> Store:
        from .sources.rdf import quads_of_text

        return cls(spark, spark.createDataFrame(quads_of_text(text, fmt), QUADS), **more)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: list[str], **more) -> Store:
        """Formats by extension; quads of quad formats keep their graph."""
        from .sources.rdf import read

        out = None
        for p in paths:
            part = read(spark, p)
            out = part if out is None else out.unionByName(part)
        return cls(spark, out, **more)

    # --- versions
    @property
    def head(self) -> Version:
        return self.versions[-1]

    @property
    def quads(self) -> DataFrame:
        return self.head.data.quads

    def version(self) -> int:
        return self.head.number

    def at(self, number: int | None = None) -> Engine:
        """A reader pinned to a version."""
        found = next((v for v in self.versions if v.number == (number or self.head.number)), None)
        if found is None:
            raise StoreError(f"version {number} is not kept")
        return Engine(self.spark, found.data, self.functions, self.transport)

    snapshot = at

    def collect_garbage(self, keep_from: int) -> None:
        """Drops versions below a floor; the head stays."""
        self.versions = [v for v in self.versions if v.number >= keep_from or v is self.head]

    def _push(self, quads: DataFrame, keys: frozenset | None) -> None:
        deltas = self.head.deltas + 1
        if deltas >= COMPACT:
            quads, deltas = written(quads, "quads"), 0
        self.versions.append(Version(self.head.number + 1, Quads(quads), deltas, keys))
        self.cache.clear()

    def change(self, adds: DataFrame | None = None, removes: DataFrame | None = None) -> int:
        """Removes, then adds; both are (g, s, p, o). Returns how many quads changed state."""
        state, n, keys, log = self.quads, 0, set(), []
        for op, rows in (("-", removes), ("+", adds)):
            if rows is None:
                continue
            rows = rows.select(*KEY).distinct()
            same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in KEY]
            test = same[0] & same[1] & same[2] & same[3]
            delta = written(rows.alias("l").join(state.alias("r"), test, "left_anti" if op == "+" else "left_semi"), "delta")
            size = delta.count()
            if not size:
                continue
            n += size
            if keys is not None:
                keys = keys | {tuple(r) for r in delta.collect()} if size <= 10_000 else None
            state = state.unionByName(delta) if op == "+" else state.alias("l").join(delta.alias("r"), test, "left_anti").select(*[F.col(f"l.{c}").alias(c) for c in KEY])
            log.append((op, delta))
        if n:
            self._push(state, None if keys is None else frozenset(keys))
            entries = [(self.head.number, op, d) for op, d in log]
            if self.open_at is not None:
                self.pending += entries
            elif self.redo_log is not None:
                self.redo_log += entries
        return n

    # --- transactions of the single writer
    def begin(self) -> None:
        if self.open_at is not None:
            raise StoreError("a transaction is open")
        self.open_at, self.pending = self.head.number, []

    def commit(self) -> None:
        if self.open_at is None:
            raise StoreError("no transaction is open")
        if self.redo_log is not None:
            self.redo_log += self.pending
        self.open_at, self.pending = None, []

    def rollback(self) -> None:
        if self.open_at is None:
            raise StoreError("no transaction is open")
        self.versions = [v for v in self.versions if v.number <= self.open_at]
        self.open_at, self.pending = None, []
        self.cache.clear()

    # --- optimistic transactions
    def transaction(self, level: str = "snapshot") -> Transaction:
        """level: read_committed, snapshot (write-write conflicts) or serializable (and what it read)."""
        return Transaction(self, level, self.head.number)

    def run_transaction(self, work, attempts: int = 3, level: str = "snapshot"):
        for k in range(attempts):
            txn = self.transaction(level)
            out = work(txn)
            try:
                txn.commit()
                return out
            except Conflict:
                if k == attempts - 1:
                    raise
        return None

    # --- triples
    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, QUADS)

    @staticmethod
    def _row(s: tuple, p: tuple, o: tuple, g: tuple | None = None) -> tuple:
        return (None if g is None else nt(g), nt(s), nt(p), nt(o))

    def insert(self, s, p, o, g=None) -> bool:
        return self.change(adds=self._frame([self._row(s, p, o, g)])) == 1

    def remove(self, s, p, o, g=None) -> bool:
        return self.change(removes=self._frame([self._row(s, p, o, g)])) == 1

    def contains(self, s, p, o, g=None) -> bool:
        row = self._row(s, p, o, g)
        return not self.quads.where(F.struct(*KEY).eqNullSafe(F.struct(*[F.lit(x).cast("string") for x in row]))).isEmpty()

    def batch_insert(self, quads: DataFrame) -> int:
        return self.change(adds=quads)

    def batch_remove(self, quads: DataFrame) -> int:
        return self.change(removes=quads)

    # --- queries and updates
    def query(self, text: str, decode: str = "native") -> Answer:
        key = (self.head.number, text, decode)
        if key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        request = S.parse(text)
        if isinstance(request, S.Update):
            changed = sum(self.apply(op) for op in request.ops)
            if self.update_log is not None:
                self.update_log.append({"ms": int(time.time() * 1000), "changed": changed, "text": text})
            return Answer("update", changed)
        answer = self.at().run(request, decode)
        if self.cache_size and not is_volatile(text):
            self.cache[key] = answer
            while len(self.cache) > self.cache_size:
                self.cache.popitem(last=False)
        return answer

    def select(self, text: str, decode: str = "native") -> DataFrame:
        answer = self.query(text, decode)
        if answer.kind != "select":
            raise S.SparqlError("not a SELECT")
        return answer.value

    def ask(self, text: str) -> bool:
        return self.query(text).value

    def construct(self, text: str) -> DataFrame:
        return self.query(text).value

    def update(self, text: str) -> int:
        answer = self.query(text)
        if answer.kind != "update":
            raise S.SparqlError("not an update")
        return answer.value

    def apply(self, op) -> int:
        if isinstance(op, (S.InsertData, S.DeleteData)):
            rows = self._frame([self._row(*q) for q in op.quads])
            return self.change(adds=rows) if isinstance(op, S.InsertData) else self.change(removes=rows)
        if isinstance(op, S.Modify):
            engine = self.at()
            c = engine.compiler()
            rel = c.pattern(op.where)
            rel.df = written(rel.df, "solutions")
            return self.change(adds=self._instances(c, op.insert, rel), removes=self._instances(c, op.delete, rel))
        if isinstance(op, S.Load):
            return self._load(op)
        if isinstance(op, S.Clear):
            test = {"default": "g is null", "named": "g is not null", "all": "true"}.get(op.target[0])
            rows = self.quads.where(test) if test else self.quads.where(F.col("g") == f"<{op.target[1]}>")
            return self.change(removes=rows)
        return 0  # CREATE

    def _instances(self, c: Compiler, template: list, rel) -> DataFrame | None:
        if not template:
            return None
        out = None
        for g in dict.fromkeys(q[3] for q in template):
            part = Engine.instantiate(c, [q[:3] for q in template if q[3] == g], rel)
            if g is not None and g[0] == "var":
                raise S.SparqlError("a graph variable in a template is not supported")
            part = part.select(F.lit(None if g is None else nt(g)).cast("string").alias("g"), "s", "p", "o")
            out = part if out is None else out.unionByName(part)
        return out.where(~F.col("s").startswith('"'))

    def _load(self, op: S.Load) -> int:
        from .sources.rdf import read

        try:
            if re.match(r"https?:", op.source):
                raise StoreError("LOAD reads local files only")
            rows = read(self.spark, op.source.removeprefix("file://"), "turtle")
            if op.graph:
                rows = rows.withColumn("g", F.lit(f"<{op.graph}>"))
            return self.change(adds=rows)
        except Exception:
            if op.silent:
                return 0
            raise

    # --- logs
    def enable_update_log(self) -> None:
        self.update_log = []

    def enable_redo_log(self) -> None:
        self.redo_log = []

    def replay_updates(self, log: list) -> int:
        return sum(self.update(entry["text"]) for entry in log)

    def replay_redo(self, log: list) -> int:
        return sum(self.change(**{"adds" if op == "+" else "removes": delta}) for _, op, delta in log)

    def save_update_log(self, path: str) -> None:
        rows = [(k, e["ms"], e["changed"], e["text"]) for k, e in enumerate(self.update_log or [])]
        self.spark.createDataFrame(rows, "seq long, ms long, changed long, text string").coalesce(1).write.mode("append").json(path)

    def load_update_log(self, path: str) -> list:
        return [r.asDict() for r in self.spark.read.schema("seq long, ms long, changed long, text string").json(path).orderBy("seq").collect()]

    # --- persistence
    def save(self, path: str) -> None:
        """Parquet, one folder a predicate hash would not help small stores: sorted by predicate for row-group pruning."""
        rows = self.quads
        rows.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.mode("overwrite").parquet(f"{path}/quads")
        counts = rows.agg(F.count("*").alias("quads"), F.count("g").alias("named")).first().asDict()
        self.spark.createDataFrame([(json.dumps(counts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **more) -> Store:
        quads = spark.read.schema(QUADS).parquet(f"{path}/quads")
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if quads.agg(F.count("*").alias("quads"), F.count("g").alias("named")).first().asDict() != meta:
            raise StoreError("corrupt database: the counts differ from the recorded ones")
        return cls(spark, quads, **more)

    backup, restore = save, load

    # --- metadata
    def stats(self) -> DataFrame:
        """One row: triples of the default graph, distinct subjects, objects and predicates, named graphs."""
        t = self.quads.where("g is null")
        return t.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"), F.count_distinct("p").alias("predicates")).crossJoin(self.quads.agg(F.count_distinct("g").alias("graphs")))

    def predicate_stats(self) -> DataFrame:
        return predicate_stats(self.quads.where("g is null"))

    def analyze(self) -> None:
        """Computes the statistics that the join order uses."""
        self.head.data.stats()

    def schema(self) -> tuple[DataFrame, DataFrame]:
        """(classes, properties), each a sorted frame of IRIs."""
        t = self.quads.where("g is null")
        pick = lambda name, column: t.where(F.col("p") == f"<{name}>").select(F.col(column).alias("iri"))
        sub, dom, rng = RDFS + "subClassOf", RDFS + "domain", RDFS + "range"
        classes = pick(TYPE, "o").unionAll(pick(sub, "s")).unionAll(pick(sub, "o")).unionAll(pick(dom, "o")).unionAll(pick(rng, "o"))
        vocabulary = [f"<{x}>" for x in (TYPE, sub, dom, rng, RDFS + "subPropertyOf")]
        props = t.where(~F.col("p").isin(vocabulary)).select(F.col("p").alias("iri")).unionAll(pick(RDFS + "subPropertyOf", "s")).unionAll(pick(RDFS + "subPropertyOf", "o")).unionAll(pick(dom, "s")).unionAll(pick(rng, "s"))
        tidy = lambda df: df.where(F.col("iri").startswith("<")).distinct().select(F.expr("substring(iri, 2, length(iri) - 2)").alias("iri")).orderBy("iri")
        return tidy(classes), tidy(props)

    def graph(self):
        """The entity graph of the default graph's triples."""
        from .operators.graph import Graph

        return Graph.of_triples(self.quads.where("g is null"))

    def weighted_graph(self, weight=None):
        from .operators.graph import WeightedGraph

        return WeightedGraph.of_triples(self.quads.where("g is null"), weight)

    # --- reasoning
    def materialize_rdfs(self) -> int:
        from .operators.reason import rdfs_closure

        new = rdfs_closure(self.quads.where("g is null").select("s", "p", "o"))
        return self.change(adds=new.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))

    def add_rule(self, name: str, text: str) -> None:
        from .operators.reason import Rule

        if name in self.rules:
            raise StoreError(f"rule {name!r} exists")
        self.rules[name] = Rule.parse(name, text)

    def remove_rule(self, name: str) -> bool:
        return self.rules.pop(name, None) is not None

    def enable_rule(self, name: str, on: bool = True) -> None:
        self.rules[name].enabled = on

    def list_rules(self) -> list[tuple[str, str, bool, int]]:
        return [(r.name, r.text, r.enabled, r.effect_count) for r in self.rules.values()]

    def run_rules(self) -> int:
        from .operators.reason import apply_rules

        new = apply_rules(self.quads.where("g is null").select("s", "p", "o"), list(self.rules.values()))
        return self.change(adds=new.select(F.lit(None).cast("string").alias("g"), "s", "p", "o"))


@dataclass
class Transaction:
    """Buffered changes against a pinned version, checked against later ones at commit."""

    store: Store
    level: str
    base: int
    adds: set = field(default_factory=set)
    removes: set = field(default_factory=set)
    reads: set = field(default_factory=set)

    def insert(self, s, p, o, g=None) -> None:
        row = Store._row(s, p, o, g)
        self.removes.discard(row)
        self.adds.add(row)

    def remove(self, s, p, o, g=None) -> None:
        row = Store._row(s, p, o, g)
        self.adds.discard(row)
        self.removes.add(row)

    def read(self, s, p, o, g=None) -> bool:
        """Like ``contains``, and part of the read set."""
        self.reads.add(Store._row(s, p, o, g))
        return self.contains(s, p, o, g)

    def contains(self, s, p, o, g=None) -> bool:
        row = Store._row(s, p, o, g)
        if row in self.adds or row in self.removes:
            return row in self.adds
        quads = self.store.quads if self.level == "read_committed" else self.store.at(self.base).dataset.quads
        return not quads.where(F.struct(*KEY).eqNullSafe(F.struct(*[F.lit(x).cast("string") for x in row]))).isEmpty()

    def commit(self) -> int:
        if self.level != "read_committed":
            mine = self.adds | self.removes | (self.reads if self.level == "serializable" else set())
            for v in self.store.versions:
                if v.number > self.base and (v.written_keys is None or mine & v.written_keys):
                    raise Conflict(f"version {v.number} changed the same quads")
        frame = self.store._frame
        self.store.change(adds=frame(sorted(self.adds, key=repr)) if self.adds else None, removes=frame(sorted(self.removes, key=repr)) if self.removes else None)
        return self.store.version()
