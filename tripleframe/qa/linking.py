"""Mentions to entities and predicates, schema context, subgraphs and citations of a store."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from ..terms import RDFS, TYPE, from_nt
from .vectors import hash_embedding, top_k

LABEL = f"<{RDFS}label>"


@dataclass
class Candidate:
    uri: str
    text: str
    score: float


def local_name(uri: str) -> str:
    """The last part of an IRI as words."""
    tail = re.split(r"[/#]", uri.rstrip("/#>"))[-1]
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|[_-]+", " ", tail)


class Linker:
    """Vector indexes of entity labels, and of predicates and types by local name."""

    def __init__(self, quads: DataFrame, min_score: float = 0.5, languages: list[str] | None = None, entity_limit: int | None = None, label: str = LABEL):
        triples, self.min_score = quads.where("g is null"), min_score
        labels = triples.where(F.col("p") == label).select(F.col("s").alias("id"), F.col("o"))
        lang = F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1)
        if languages:
            labels = labels.where((lang == "") | lang.isin(languages))
        text = F.regexp_extract("o", r'(?s)^"(.*)"', 1)
        entities = labels.select("id", text.alias("text"))
        self.entities = written((entities.orderBy("id").limit(entity_limit) if entity_limit else entities).withColumn("vec", hash_embedding(F.col("text"))), "entities")
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace("id", r"^<|[/#]?>$", ""), r"^.*[/#]", ""), r"(?<=[a-z0-9])(?=[A-Z])|[_-]+", " ")
        named = lambda df: written(df.where(F.col("id").startswith("<")).distinct().withColumn("text", name).withColumn("vec", hash_embedding(F.col("text"))), "names")
        self.predicates = named(triples.select(F.col("p").alias("id")))
        self.types = named(triples.where(F.col("p") == f"<{TYPE}>").select(F.col("o").alias("id")))

    def _link(self, index: DataFrame, mention: str, k: int) -> list[Candidate]:
        spark = index.sparkSession
        vec = spark.range(1).select(hash_embedding(F.lit(mention))).first()[0]
        rows = top_k(index.withColumn("key", F.struct("id", "text")), vec, k, "key").collect()
        found = [Candidate(from_nt(r["key"]["id"])[1], r["key"]["text"], r["score"]) for r in rows]
        good = [c for c in found if c.score >= self.min_score]
        return good or found[:1]  # nothing good enough: the best there is

    def link_mention(self, mention: str, k: int = 5) -> list[Candidate]:
        return self._link(self.entities, mention, k)

    def link_predicate(self, phrase: str, k: int = 5) -> list[Candidate]:
        return self._link(self.predicates, phrase, k)


@dataclass
class SchemaContext:
    entities: dict = field(default_factory=dict)  # uri -> {types, out, into, truncated}
    predicates: dict = field(default_factory=dict)  # uri -> {domain, range}

    def text(self) -> str:
        lines = [f"{u}: types {d['types']}; out {d['out']}; in {d['into']}" for u, d in self.entities.items()]
        return "\n".join(lines + [f"{u}: {d['domain']} -> {d['range']}" for u, d in self.predicates.items()])


def schema_context(quads: DataFrame, entities: list[str], predicates: list[str], sample: int = 50) -> SchemaContext:
    """Predicates and types around entities, and the types at the ends of predicates, each capped at ``sample``."""
    t, out = quads.where("g is null"), SchemaContext()

    def few(df):
        rows = sorted(r[0] for r in df.distinct().limit(sample + 1).collect())
        return rows[:sample], len(rows) > sample

    for uri in entities:
        own = t.where(F.col("s") == f"<{uri}>")
        (types, a), (leave, b), (enter, c) = few(own.where(F.col("p") == f"<{TYPE}>").select("o")), few(own.select("p")), few(t.where(F.col("o") == f"<{uri}>").select("p"))
        out.entities[uri] = {"types": types, "out": leave, "into": enter, "truncated": a or b or c}
    kinds = t.where(F.col("p") == f"<{TYPE}>").select(F.col("s").alias("x"), F.col("o").alias("kind"))
    for uri in predicates:
        own = t.where(F.col("p") == f"<{uri}>")
        out.predicates[uri] = {"domain": few(own.select(F.col("s").alias("x")).join(kinds, "x").select("kind"))[0], "range": few(own.select(F.col("o").alias("x")).join(kinds, "x").select("kind"))[0]}
    return out


def subgraph(triples: DataFrame, seeds: list[str], hops: int = 2, per_node: int = 50, total: int = 1000) -> DataFrame:
    """Triples around seed terms by steps in and out; at most ``per_node`` a node and ``total`` in all (the caps are the feature)."""
    spark = triples.sparkSession
    frontier = spark.createDataFrame([(s,) for s in seeds], "node string")
    seen, found = frontier, None
    for _ in range(hops):
        near = frontier.join(triples, F.col("node") == F.col("s")).select("node", "s", "p", "o").unionAll(frontier.join(triples, F.col("node") == F.col("o")).select("node", "s", "p", "o"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy("s", "p", "o"))
        step = written(near.withColumn("k", rank).where(F.col("k") <= per_node).select("s", "p", "o").distinct(), "subgraph")
        found = step if found is None else written(found.unionAll(step).distinct(), "subgraph")
        ends = step.select(F.col("s").alias("node")).unionAll(step.select("o")).distinct()
        frontier = written(ends.join(seen, "node", "left_anti"), "subgraph")
        seen = seen.unionAll(frontier)
    return found.orderBy("s", "p", "o").limit(total) if found is not None else triples.limit(0)


def citations(triples: DataFrame, uris: list[str], per_entity: int = 5, max_entities: int = 10, max_total: int = 30) -> DataFrame:
    """Statements about answer entities, in order of predicate and object, capped an entity and in all."""
    spark = triples.sparkSession
    wanted = spark.createDataFrame([(f"<{u}>", k) for k, u in enumerate(uris[:max_entities])], "s string, place int")
    rank = F.row_number().over(Window.partitionBy("s").orderBy("p", "o"))
    return triples.join(F.broadcast(wanted), "s").withColumn("k", rank).where(F.col("k") <= per_entity).orderBy("place", "k").limit(max_total).select("s", "p", "o")
