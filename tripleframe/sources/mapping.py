"""Relational tables as a virtual RDF dataset: predicates are columns, nothing is materialised.

A ``Class`` maps the rows of a table to subjects ``prefix + key``; each of its
properties is a column (a literal typed by the column's type) or a reference
(``prefix + column``). ``Edges`` are distinct pairs of references of one table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, number
from ..terms import TYPE


@dataclass
class Class:
    iri: str
    table: str
    prefix: str
    key: str
    columns: dict[str, str] = field(default_factory=dict)  # predicate -> column
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)  # predicate -> (prefix, column)
    langs: dict[str, str] = field(default_factory=dict)  # predicate -> column with the language of its text


@dataclass
class Edges:
    predicate: str
    table: str
    subject: tuple[str, str]
    object: tuple[str, str]


@dataclass
class Prop:
    """One way to read a predicate."""

    table: str
    subject: tuple[str, str]
    value: tuple  # ("column", name), ("lang", name, language column), ("ref", prefix, name), ("class", iri)
    unique: bool


class Mapping:
    """A dataset over tables given by ``tables(name) -> DataFrame``."""

    named_graphs = False

    def __init__(self, tables, classes: list[Class], edges: list[Edges] = ()):
        self.tables, self.frames = tables, {}
        self.props: dict[str, list[Prop]] = {}
        for c in classes:
            subject = (c.prefix, c.key)
            self.props.setdefault(TYPE, []).append(Prop(c.table, subject, ("class", c.iri), True))
            for p, column in c.columns.items():
                self.props.setdefault(p, []).append(Prop(c.table, subject, ("lang", column, c.langs[p]) if p in c.langs else ("column", column), True))
            for p, (prefix, column) in c.refs.items():
                self.props.setdefault(p, []).append(Prop(c.table, subject, ("ref", prefix, column), True))
        for e in edges:
            self.props.setdefault(e.predicate, []).append(Prop(e.table, e.subject, ("ref", *e.object), False))

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.tables(name)
        return self.frames[name]

    def predicates(self) -> list[str]:
        return list(self.props)

    def subject_val(self, prop: Prop) -> Val:
        return Val("key", F.col(f"`{prop.subject[1]}`"), prefix=prop.subject[0])

    def object_val(self, prop: Prop) -> Val:
        how, *rest = prop.value
        if how == "class":
            return Val("iri", F.lit(rest[0]), fixed=("iri", rest[0]))
        if how == "ref":
            return Val("key", F.col(f"`{rest[1]}`"), prefix=rest[0])
        column = F.col(f"`{rest[0]}`")
        if how == "lang":
            from ..functions.builtins import strlang

            return strlang(Val("str", column), Val("str", F.col(f"`{rest[1]}`")))
        kind = self.frame(prop.table).schema[rest[0]].dataType.simpleString()
        if kind in ("bigint", "int", "smallint", "tinyint"):
            return number(column.cast("long"), column.cast("double"), True)
        if kind in ("double", "float") or kind.startswith("decimal"):
            return number(F.lit(None).cast("long"), column.cast("double"))
        if kind.startswith("timestamp") or kind == "date":
            return Val("time", column.cast("timestamp"))
        if kind == "boolean":
            return Val("bool", column)
        return Val("str", column.cast("string"))

    def columns_of(self, prop: Prop) -> list[str]:
        return [prop.subject[1], *(x for x in (prop.value[1:] if prop.value[0] in ("column", "lang") else prop.value[2:] if prop.value[0] == "ref" else []))]
