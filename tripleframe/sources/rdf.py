"""RDF readers and writers.

N-Triples and N-Quads are split by line and parsed by column expressions, so they
read in parallel whatever their size. Turtle, TriG and RDF/XML can't be split; each
file is one row of a pandas function. Blank labels are scoped by document.
"""

import os
import re
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, RDF, TYPE, nt, unescape

FORMATS = {"nt": "ntriples", "ttl": "turtle", "turtle": "turtle", "nq": "nquads", "nquads": "nquads", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "rdfs": "rdfxml"}
NODE = r"<[^>]*>|_:[^\s.,;<>\"]+(?:\.[^\s.,;<>\"]+)*"
LITERAL = r'"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?'
LINE = rf"^\s*({NODE})\s*(<[^>]*>)\s*({NODE}|{LITERAL})\s*({NODE})?\s*\.?\s*(?:#.*)?$"


class RdfError(ValueError):
    """A document breaks its grammar."""


def format_of(path: str) -> str:
    """By extension; Turtle for others."""
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1][1:].lower(), "turtle")


def read(spark: SparkSession, path: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Quads (g, s, p, o) of files in any of the formats."""
    fmt = fmt or format_of(path)
    if fmt in ("ntriples", "nquads"):
        return read_lines(spark, path, quads=fmt == "nquads", strict=strict)
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")

    def run(parts):
        for part in parts:
            for name, text in zip(part["name"], part["value"], strict=True):
                yield pd.DataFrame(quads_of_text(text, fmt, scope=f"{zlib.crc32(name.encode()):08x}"), columns=["g", "s", "p", "o"])

    return files.mapInPandas(run, "g string, s string, p string, o string")


def canonical(term: Column) -> Column:
    r"""Escapes other than \\ \" \n \r \t (\uXXXX and so on) are decoded."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: x if x is None else canonical_text(x))

    return F.when(F.regexp_like(term, F.lit(r"\\[^\\\"nrt]")), decode(term)).otherwise(term)


def canonical_text(text: str) -> str:
    if not text.startswith('"'):
        return unescape(text)
    end = text.rindex('"')
    return nt(("lit", unescape(text[1:end]), None, None)) + text[end + 1 :]


def read_lines(spark: SparkSession, path: str, quads: bool = False, strict: bool = True) -> DataFrame:
    lines = spark.read.text(path).where(~F.regexp_like("value", F.lit(r"^\s*(#.*)?$")))
    part = lambda k: F.regexp_extract("value", LINE, k)
    bad = part(1) == ""
    if not quads:
        bad = bad | (part(4) != "")
    if strict:
        checked = F.when(bad, F.raise_error(F.concat(F.lit("not a statement: "), F.col("value")))).otherwise(part(1))
    else:
        lines, checked = lines.where(~bad), part(1)
    return lines.select(F.when(part(4) != "", canonical(part(4))).alias("g"), canonical(checked).alias("s"), canonical(part(2)).alias("p"), canonical(part(3)).alias("o"))


def quads_of_text(text: str, fmt: str = "turtle", scope: str = "") -> list[tuple]:
    """(g, s, p, o) canonical strings of a document; g is None in the default graph."""
    if fmt in ("ntriples", "nquads"):
        out = []
        for number, line in enumerate(text.splitlines(), 1):
            if re.match(r"\s*(#.*)?$", line):
                continue
            m = re.match(LINE, line)
            if not m or (m[4] and fmt == "ntriples"):
                raise RdfError(f"line {number}: not a statement: {line!r}")
            out.append((canonical_text(m[4]) if m[4] else None, canonical_text(m[1]), canonical_text(m[2]), canonical_text(m[3])))
        return out
    if fmt == "rdfxml":
        return [(None, *map(nt, t)) for t in RdfXml(text, scope).triples]
    if fmt not in ("turtle", "trig"):
        raise RdfError(f"unknown format {fmt!r}")
    return [tuple(None if x is None else nt(x) for x in q) for q in Turtle(text, fmt == "trig", scope).quads]


TURTLE = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>"{}|^`\\\x00-\x20]*|\\U[0-9A-Fa-f]{8}[^<>"{}|^`\\\x00-\x20]*)*>)
  |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<at>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  |(?P<num>[+-]?(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
  |(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9a-fA-F]{2}|\\.)(?:(?:[\w:.-]|%[0-9a-fA-F]{2}|\\.)*(?:[\w:-]|%[0-9a-fA-F]{2}|\\.))?)?)
  |(?P<word>[A-Za-z]+)
  |(?P<op>\^\^|[{}()\[\];,.])""",
    re.X | re.S,
)


class Turtle:
    """Turtle and, with graph blocks, TriG."""

    def __init__(self, text: str, trig: bool = False, scope: str = ""):
        self.tokens, at = [], 0
        while at < len(text):
            m = TURTLE.match(text, at)
            if m is None:
                raise RdfError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.trig, self.scope = 0, trig, scope
        self.prefixes, self.base, self.fresh = {}, "", 0
        self.graph, self.quads = None, []
        while self.now[0] != "end":
            self.statement()

    @property
    def now(self):
        return self.tokens[self.at]

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def op(self, text: str) -> bool:
        if self.now == ("op", text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            raise RdfError(f"expected {text!r}, found {self.now[1]!r}")

    def statement(self) -> None:
        kind, value = self.now
        name = value.lower().lstrip("@")
        if (kind == "at" and name in ("prefix", "base")) or (kind == "word" and name in ("prefix", "base")):
            self.at += 1
            if name == "prefix":
                key = self.next()[1]
                if not key.endswith(":"):
                    raise RdfError(f"a prefix must end with a colon: {key!r}")
                self.prefixes[key[:-1]] = self.resolve(self.next()[1][1:-1])
            else:
                self.base = self.resolve(self.next()[1][1:-1])
            if kind == "at":
                self.need(".")
            return
        if self.trig:
            if kind == "word" and name == "graph":
                self.at += 1
                return self.block(self.node())
            if (kind, value) == ("op", "{"):
                return self.block(None)
            if kind in ("iri", "pname", "blank") and self.tokens[self.at + 1] == ("op", "{"):
                return self.block(self.node())
        self.triples()
        self.need(".")
        return None

    def block(self, graph) -> None:
        self.graph = graph
        self.need("{")
        while not self.op("}"):
            self.triples()
            self.op(".")
        self.graph = None

    def emit(self, s, p, o) -> None:
        self.quads.append((self.graph, s, p, o))

    def blank(self) -> tuple:
        self.fresh += 1
        return ("blank", f"g{self.scope}n{self.fresh}")

    def triples(self) -> None:
        if self.now == ("op", "["):
            subject = self.node()
            if self.now[1] in (".", "}"):
                return
        else:
            subject = self.node()
        self.predicates(subject)

    def predicates(self, subject) -> None:
        while True:
            kind, value = self.now
            if kind == "word" and value == "a":
                self.at += 1
                verb = ("iri", TYPE)
            else:
                verb = self.node()
                if verb[0] != "iri":
                    raise RdfError("a predicate must be an IRI")
            while True:
                self.emit(subject, verb, self.node())
                if not self.op(","):
                    break
            more = False
            while self.op(";"):
                more = True
            if not more or self.now[1] in (".", "]", "}") and self.now[0] == "op":
                return

    def resolve(self, text: str) -> str:
        from urllib.parse import urljoin

        text = unescape(text)
        return text if not self.base or re.match(r"[A-Za-z][\w+.-]*:", text) else urljoin(self.base, text)

    def node(self) -> tuple:
        kind, value = self.next()
        if kind == "iri":
            return ("iri", self.resolve(value[1:-1]))
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise RdfError(f"unknown prefix {prefix!r}")
            return ("iri", self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return ("blank", (f"d{self.scope}_" if self.scope else "") + value[2:])
        if kind == "str":
            text = unescape(value[3:-3] if len(value) >= 6 and value[:3] in ('"""', "'''") else value[1:-1])
            if self.now[0] == "at":
                return ("lit", text, None, self.next()[1][1:])
            if self.op("^^"):
                return ("lit", text, self.node()[1], None)
            return ("lit", text, None, None)
        if kind == "num":
            return ("lit", value, DOUBLE if "e" in value.lower() else DECIMAL if "." in value else INTEGER, None)
        if kind == "word" and value in ("true", "false"):
            return ("lit", value, BOOLEAN, None)
        if (kind, value) == ("op", "["):
            out = self.blank()
            if not self.op("]"):
                self.predicates(out)
                self.need("]")
            return out
        if (kind, value) == ("op", "("):
            items = []
            while not self.op(")"):
                items.append(self.node())
            rest: tuple = ("iri", RDF + "nil")
            cells = [self.blank() for _ in items]
            for k in range(len(items) - 1, -1, -1):
                self.emit(cells[k], ("iri", RDF + "first"), items[k])
                self.emit(cells[k], ("iri", RDF + "rest"), rest)
                rest = cells[k]
            return rest
        raise RdfError(f"expected a term, found {value!r}")


class RdfXml:
    """RDF/XML node and property elements."""

    LANG = "{http://www.w3.org/XML/1998/namespace}lang"
    BASE = "{http://www.w3.org/XML/1998/namespace}base"

    def __init__(self, text: str, scope: str = ""):
        self.triples: list[tuple] = []
        self.scope, self.fresh = scope, 0
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError as x:
            raise RdfError(f"not well-formed: {x}") from x
        if root.tag == self.q("RDF"):
            for child in root:
                self.node(child, root.get(self.BASE, ""), root.get(self.LANG))
        else:
            self.node(root, "", None)

    @staticmethod
    def q(name: str) -> str:
        return f"{{{RDF}}}{name}"

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def blank(self, label: str | None = None) -> tuple:
        if label is not None:
            return ("blank", (f"d{self.scope}_" if self.scope else "") + label)
        self.fresh += 1
        return ("blank", f"x{self.scope}n{self.fresh}")

    @staticmethod
    def resolve(base: str, text: str) -> str:
        from urllib.parse import urljoin

        return urljoin(base, text) if base else text

    def node(self, e, base: str, lang: str | None) -> tuple:
        base, lang = e.get(self.BASE, base), e.get(self.LANG, lang)
        if (about := e.get(self.q("about"))) is not None:
            subject = ("iri", self.resolve(base, about))
        elif (own := e.get(self.q("ID"))) is not None:
            subject = ("iri", self.resolve(base, f"#{own}"))
        else:
            subject = self.blank(e.get(self.q("nodeID")))
        if e.tag != self.q("Description"):
            self.triples.append((subject, ("iri", TYPE), ("iri", self.name(e.tag))))
        for key, value in e.attrib.items():
            if key == self.q("type"):
                self.triples.append((subject, ("iri", TYPE), ("iri", self.resolve(base, value))))
            elif not key.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}")):
                self.triples.append((subject, ("iri", self.name(key)), ("lit", value, None, lang)))
        count = 0
        for child in e:
            if child.tag == self.q("li"):
                count += 1
            self.property(subject, child, base, lang, count)
        return subject

    def property(self, subject: tuple, e, base: str, lang: str | None, count: int) -> None:
        base, lang = e.get(self.BASE, base), e.get(self.LANG, lang)
        verb = ("iri", RDF + f"_{count}" if e.tag == self.q("li") else self.name(e.tag))
        kind = e.get(self.q("parseType"))
        extra = {k: v for k, v in e.attrib.items() if not k.startswith((f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}"))}
        if kind == "Resource":
            out = self.blank()
            for k, child in enumerate(e):
                self.property(out, child, base, lang, k + 1)
        elif kind == "Collection":
            items = [self.node(child, base, lang) for child in e]
            out = ("iri", RDF + "nil")
            cells = [self.blank() for _ in items]
            for cell, item in zip(cells[::-1], items[::-1], strict=True):
                self.triples += [(cell, ("iri", RDF + "first"), item), (cell, ("iri", RDF + "rest"), out)]
                out = cell
        elif kind is not None:
            inner = (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
            out = ("lit", inner, RDF + "XMLLiteral", None)
        elif (resource := e.get(self.q("resource"))) is not None:
            out = ("iri", self.resolve(base, resource))
        elif (label := e.get(self.q("nodeID"))) is not None:
            out = self.blank(label)
        elif len(e):
            out = self.node(e[0], base, lang)
        elif extra:
            out = self.blank()
        else:
            datatype = e.get(self.q("datatype"))
            out = ("lit", e.text or "", datatype, None if datatype else lang)
        for key, value in extra.items():
            self.triples.append((out, ("iri", self.name(key)), ("lit", value, None, lang)))
        self.triples.append((subject, verb, out))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One statement a line; graph labels, if there are any, make it N-Quads."""
    g = [F.col("g")] if "g" in triples.columns else []
    triples.select(F.concat_ws(" ", "s", "p", "o", *g, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def ntriples_body(triples: DataFrame) -> str:
    """The text of a CONSTRUCT or DESCRIBE result, row by row."""
    return "".join(f"{r['s']} {r['p']} {r['o']} .\n" for r in triples.toLocalIterator())
