"""SPARQL text -> algebra.

Expressions are tuples headed by a word: var, const, or, and, not, cmp, arith, neg,
call, exists, agg. Patterns and requests are the small classes below.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, TYPE, unescape


class SparqlError(ValueError):
    """The text is not in the supported language."""


@dataclass
class Bgp:
    triples: list


@dataclass
class PathTriple:
    subject: tuple
    path: tuple
    object: tuple


@dataclass
class Join:
    parts: list


@dataclass
class LeftJoin:
    left: object
    right: object
    filters: list


@dataclass
class Union:
    parts: list


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    inner: object
    tests: list


@dataclass
class Extend:
    inner: object
    var: str
    expr: tuple


@dataclass
class Values:
    vars: list
    rows: list


@dataclass
class SubSelect:
    query: object


@dataclass
class Graph:
    name: tuple
    inner: object


@dataclass
class Service:
    endpoint: tuple
    silent: bool
    inner: object
    text: str


@dataclass
class Select:
    items: list | None  # (var, expr or None); None is *
    distinct: bool
    where: object
    group: list = field(default_factory=list)  # (expr, alias or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expr, descending)
    limit: int | None = None
    offset: int = 0


@dataclass
class Ask:
    where: object


@dataclass
class Construct:
    template: list
    query: Select


@dataclass
class Describe:
    targets: list | None
    query: Select | None


@dataclass
class InsertData:
    quads: list


@dataclass
class DeleteData:
    quads: list


@dataclass
class Modify:
    delete: list
    insert: list
    where: object


@dataclass
class Load:
    source: str
    silent: bool
    graph: str | None


@dataclass
class Clear:
    target: tuple  # ("default",), ("named",), ("all",) or ("iri", name)


@dataclass
class Create:
    graph: str


@dataclass
class Update:
    ops: list


TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<var>[?$]\w+)
  |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
  |(?P<num>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  |(?P<blank>_:[\w.-]*[\w-])
  |(?P<pname>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:]|%[0-9a-fA-F]{2}|\\.)(?:[\w:.-]|%[0-9a-fA-F]{2}|\\.)*)?)
  |(?P<word>[A-Za-z_]\w*)
  |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\];,.=<>!*/+\-|^?])""",
    re.X | re.S,
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def tokenize(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise SparqlError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        kind, value = m.lastgroup, m[0]
        if kind == "pname":  # a name may hold dots but not end with one
            trimmed = value.rstrip(".")
            value = trimmed if ":" in trimmed else value
        if kind != "skip":
            out.append((kind, value, at))
        at += len(value)
    out.append(("end", "", len(text)))
    return out


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0
        self.prefixes: dict[str, str] = {}
        self.base, self.fresh = "", 0

    # --- tokens
    @property
    def now(self):
        return self.tokens[self.at]

    def is_op(self, *ops):
        return self.now[0] == "op" and self.now[1] in ops

    def is_word(self, *words):
        return self.now[0] == "word" and self.now[1].upper() in words

    def take_op(self, *ops):
        if self.is_op(*ops):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def take_word(self, *words):
        if self.is_word(*words):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need_op(self, op):
        if not self.take_op(op):
            raise SparqlError(f"expected {op!r} at {self.now[2]}, found {self.now[1]!r}")

    def need_word(self, word):
        if not self.take_word(word):
            raise SparqlError(f"expected {word} at {self.now[2]}, found {self.now[1]!r}")

    def next(self):
        self.at += 1
        return self.tokens[self.at - 1]

    # --- requests
    def request(self):
        self.prologue()
        if self.is_word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE"):
            out = {"SELECT": self.select, "ASK": self.ask, "CONSTRUCT": self.construct, "DESCRIBE": self.describe}[self.now[1].upper()]()
        else:
            out = Update(self.updates())
        if self.now[0] != "end":
            raise SparqlError(f"text after the end of the request at {self.now[2]}: {self.now[1]!r}")
        return out

    def prologue(self):
        while True:
            if self.take_word("PREFIX"):
                name = self.next()
                if name[0] != "pname" or not name[1].endswith(":"):
                    raise SparqlError("PREFIX needs a name that ends with a colon")
                self.prefixes[name[1][:-1]] = self.iri_token()
            elif self.take_word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                return

    def iri_token(self) -> str:
        kind, value, at = self.next()
        if kind == "iri":
            text = unescape(value[1:-1])
            return text if re.match(r"[A-Za-z][\w+.-]*:", text) or not self.base else self.base + text
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlError(f"expected an IRI at {at}, found {value!r}")

    def datasets(self):
        while self.take_word("FROM"):
            self.take_word("NAMED")
            self.iri_token()

    def select(self) -> Select:
        self.need_word("SELECT")
        distinct = bool(self.take_word("DISTINCT"))
        if not distinct:
            self.take_word("REDUCED")
        items: list | None = []
        if self.take_op("*"):
            items = None
        else:
            while True:
                if self.now[0] == "var":
                    items.append((self.next()[1][1:], None))
                elif self.take_op("("):
                    expr = self.expression()
                    self.need_word("AS")
                    items.append((self.var(), expr))
                    self.need_op(")")
                else:
                    break
            if not items:
                raise SparqlError("SELECT without variables")
        self.datasets()
        self.take_word("WHERE")
        out = Select(items, distinct, self.group())
        self.modifiers(out)
        return out

    def var(self) -> str:
        kind, value, at = self.next()
        if kind != "var":
            raise SparqlError(f"expected a variable at {at}, found {value!r}")
        return value[1:]

    def modifiers(self, q: Select):
        if self.take_word("GROUP"):
            self.need_word("BY")
            while True:
                if self.now[0] == "var":
                    q.group.append((("var", self.next()[1][1:]), None))
                elif self.take_op("("):
                    expr = self.expression()
                    alias = self.var() if self.take_word("AS") else None
                    self.need_op(")")
                    q.group.append((expr, alias))
                elif self.now[0] == "word" and self.tokens[self.at + 1][1] == "(" and not self.is_word("HAVING", "ORDER"):
                    q.group.append((self.primary(), None))
                else:
                    break
            if not q.group:
                raise SparqlError("GROUP BY without keys")
        while self.take_word("HAVING") or (q.having and self.is_op("(")):
            q.having.append(self.constraint())
        if self.take_word("ORDER"):
            self.need_word("BY")
            while True:
                way = self.take_word("ASC", "DESC")
                if way:
                    self.need_op("(")
                    q.order.append((self.expression(), way == "DESC"))
                    self.need_op(")")
                elif self.now[0] == "var":
                    q.order.append((("var", self.next()[1][1:]), False))
                elif self.is_op("("):
                    q.order.append((self.constraint(), False))
                elif self.now[0] == "word" and self.tokens[self.at + 1][1] == "(":
                    q.order.append((self.primary(), False))
                else:
                    break
        while word := self.take_word("LIMIT", "OFFSET"):
            kind, value, at = self.next()
            if kind != "num" or not value.isdigit():
                raise SparqlError(f"{word} needs an integer at {at}")
            if word == "LIMIT":
                q.limit = int(value)
            else:
                q.offset = int(value)

    def ask(self) -> Ask:
        self.need_word("ASK")
        self.datasets()
        self.take_word("WHERE")
        out = Ask(self.group())
        self.modifiers(Select(None, False, None))
        return out

    def construct(self) -> Construct:
        self.need_word("CONSTRUCT")
        if self.is_op("{"):
            template = self.template()
            self.datasets()
            self.take_word("WHERE")
            where = self.group()
        else:
            self.datasets()
            self.need_word("WHERE")
            template = self.template()
            where = Bgp([t[:3] for t in template])
        query = Select(None, False, where)
        self.modifiers(query)
        return Construct(template, query)

    def describe(self) -> Describe:
        self.need_word("DESCRIBE")
        targets: list | None = []
        if self.take_op("*"):
            targets = None
        else:
            while self.now[0] in ("var", "iri", "pname"):
                targets.append(("var", self.next()[1][1:]) if self.now[0] == "var" else ("iri", self.iri_token()))
        self.datasets()
        query = None
        if self.take_word("WHERE") or self.is_op("{"):
            query = Select(None, False, self.group())
            self.modifiers(query)
        return Describe(targets, query)

    # --- updates
    def updates(self) -> list:
        out = []
        while True:
            self.prologue()
            if self.now[0] == "end":
                break
            out.append(self.update())
            if not self.take_op(";"):
                break
        if not out:
            raise SparqlError("empty request")
        return out

    def update(self):
        if self.take_word("WITH"):
            self.iri_token()
        word = self.take_word("INSERT", "DELETE", "LOAD", "CLEAR", "DROP", "CREATE")
        if word == "INSERT":
            if self.take_word("DATA"):
                return InsertData(self.ground())
            insert = self.template(quads=True)
            return Modify([], insert, self.using_where())
        if word == "DELETE":
            if self.take_word("DATA"):
                return DeleteData(self.ground())
            if self.take_word("WHERE"):
                quads = self.template(quads=True)
                return Modify(quads, [], quads_pattern(quads))
            delete = self.template(quads=True)
            insert = self.template(quads=True) if self.take_word("INSERT") else []
            return Modify(delete, insert, self.using_where())
        if word == "LOAD":
            silent = bool(self.take_word("SILENT"))
            source, graph = self.iri_token(), None
            if self.take_word("INTO"):
                self.need_word("GRAPH")
                graph = self.iri_token()
            return Load(source, silent, graph)
        if word in ("CLEAR", "DROP"):
            self.take_word("SILENT")
            kind = self.take_word("DEFAULT", "NAMED", "ALL")
            if kind:
                return Clear((kind.lower(),))
            self.need_word("GRAPH")
            return Clear(("iri", self.iri_token()))
        if word == "CREATE":
            self.take_word("SILENT")
            self.need_word("GRAPH")
            return Create(self.iri_token())
        raise SparqlError(f"unknown request at {self.now[2]}: {self.now[1]!r}")

    def using_where(self):
        while self.take_word("USING"):
            self.take_word("NAMED")
            self.iri_token()
        self.need_word("WHERE")
        return self.group()

    def ground(self) -> list:
        quads = self.template(quads=True)
        if any(t and t[0] == "var" for q in quads for t in q):
            raise SparqlError("variables are not allowed in data")
        return quads

    def template(self, quads: bool = False) -> list:
        """Triples (or quads with graph or None) between braces."""
        self.need_op("{")
        out = []
        while not self.take_op("}"):
            if quads and self.take_word("GRAPH"):
                name = self.term()
                self.need_op("{")
                while not self.take_op("}"):
                    out += [(*t, name) for t in self.triples_same_subject(paths=False)]
                    self.take_op(".")
            else:
                out += [(*t, None) for t in self.triples_same_subject(paths=False)]
            self.take_op(".")
        return out

    # --- patterns
    def group(self):
        self.need_op("{")
        if self.is_word("SELECT"):
            out = SubSelect(self.select())
            self.need_op("}")
            return out
        parts: list = []
        tests: list = []

        def so_far():
            return parts[0] if len(parts) == 1 else Join(list(parts))

        while not self.take_op("}"):
            if self.take_word("FILTER"):
                tests.append(self.constraint())
            elif self.take_word("OPTIONAL"):
                right = self.group()
                filters = []
                if isinstance(right, Filter):
                    right, filters = right.inner, right.tests
                parts[:] = [LeftJoin(so_far(), right, filters)]
            elif self.take_word("MINUS"):
                parts[:] = [Minus(so_far(), self.group())]
            elif self.take_word("BIND"):
                self.need_op("(")
                expr = self.expression()
                self.need_word("AS")
                parts[:] = [Extend(so_far(), self.var(), expr)]
                self.need_op(")")
            elif self.take_word("VALUES"):
                parts.append(self.values())
            elif self.take_word("GRAPH"):
                name = self.term()
                parts.append(Graph(name, self.group()))
            elif self.take_word("SERVICE"):
                silent = bool(self.take_word("SILENT"))
                endpoint = self.term()
                start = self.now[2]
                inner = self.group()
                parts.append(Service(endpoint, silent, inner, self.text[start : self.tokens[self.at - 1][2] + 1]))
            elif self.is_op("{"):
                arms = [self.group()]
                while self.take_word("UNION"):
                    arms.append(self.group())
                parts.append(arms[0] if len(arms) == 1 else Union(arms))
            else:
                bgp = parts[-1] if parts and isinstance(parts[-1], Bgp) else None
                for s, p, o in self.triples_same_subject(paths=True):
                    if p[0] == "path":
                        parts.append(PathTriple(s, p[1], o))
                        bgp = None
                    else:
                        if bgp is None:
                            bgp = next((x for x in parts if isinstance(x, Bgp)), None)
                            if bgp is None:
                                bgp = Bgp([])
                                parts.append(bgp)
                        bgp.triples.append((s, p, o))
            self.take_op(".")
        inner = so_far() if parts else Join([])
        return Filter(inner, tests) if tests else inner

    def values(self) -> Values:
        if self.take_op("("):
            names = []
            while not self.take_op(")"):
                names.append(self.var())
            many = True
        else:
            names, many = [self.var()], False
        self.need_op("{")
        rows = []
        while not self.take_op("}"):
            if many:
                self.need_op("(")
                row = []
                while not self.take_op(")"):
                    row.append(None if self.take_word("UNDEF") else self.term())
                if len(row) != len(names):
                    raise SparqlError("a VALUES row has another number of terms than variables")
                rows.append(row)
            else:
                rows.append([None if self.take_word("UNDEF") else self.term()])
        return Values(names, rows)

    def triples_same_subject(self, paths: bool) -> list:
        out, subject = [], self.term()
        while True:
            verb = self.verb(paths)
            while True:
                out.append((subject, verb, self.term()))
                if not self.take_op(","):
                    break
            more = False
            while self.take_op(";"):
                more = True
            if not more or self.is_op(".", "}"):
                return out

    def verb(self, paths: bool) -> tuple:
        if self.now[0] == "var":
            return ("var", self.next()[1][1:])
        if not paths:
            return self.simple_verb()
        path = self.path_alternative()
        return ("iri", path[1]) if path[0] == "iri" else ("path", path)

    def simple_verb(self) -> tuple:
        if self.now[0] == "word" and self.now[1] == "a":
            self.at += 1
            return ("iri", TYPE)
        return ("iri", self.iri_token())

    def path_alternative(self) -> tuple:
        arms = [self.path_sequence()]
        while self.take_op("|"):
            arms.append(self.path_sequence())
        return arms[0] if len(arms) == 1 else ("alt", *arms)

    def path_sequence(self) -> tuple:
        steps = [self.path_step()]
        while self.take_op("/"):
            steps.append(self.path_step())
        return steps[0] if len(steps) == 1 else ("seq", *steps)

    def path_step(self) -> tuple:
        if self.take_op("^"):
            return ("inv", self.path_postfix())
        return self.path_postfix()

    def path_postfix(self) -> tuple:
        if self.take_op("("):
            inner = self.path_alternative()
            self.need_op(")")
        elif self.take_op("!"):
            entries = []
            if self.take_op("("):
                while not self.take_op(")"):
                    entries.append(self.negated())
                    self.take_op("|")
            else:
                entries.append(self.negated())
            inner = ("neg", *entries)
        else:
            inner = self.simple_verb()
        op = self.take_op("*", "+", "?")
        return ({"*": "star", "+": "plus", "?": "opt"}[op], inner) if op else inner

    def negated(self) -> tuple:
        return (bool(self.take_op("^")), self.simple_verb()[1])

    def term(self) -> tuple:
        kind, value, at = self.now
        if kind == "var":
            self.at += 1
            return ("var", value[1:])
        if kind in ("iri", "pname"):
            return ("iri", self.iri_token())
        if kind == "blank":
            self.at += 1
            return ("blank", value[2:])
        if kind == "str":
            self.at += 1
            text = unescape(value[3:-3] if value[:3] in ('"""', "'''") else value[1:-1])
            if self.now[0] == "lang":
                return ("lit", text, None, self.next()[1][1:])
            if self.take_op("^^"):
                return ("lit", text, self.iri_token(), None)
            return ("lit", text, None, None)
        sign = ""
        if kind == "op" and value in "+-" and self.tokens[self.at + 1][0] == "num":
            self.at += 1
            sign, (kind, value, at) = value, self.now
        if kind == "num":
            self.at += 1
            return ("lit", sign + value, DOUBLE if "e" in value.lower() else DECIMAL if "." in value else INTEGER, None)
        if kind == "word" and value.lower() in ("true", "false"):
            self.at += 1
            return ("lit", value.lower(), BOOLEAN, None)
        raise SparqlError(f"expected a term at {at}, found {value!r}")

    # --- expressions
    def constraint(self) -> tuple:
        return self.primary()

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.take_op("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.take_op("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        op = self.take_op("=", "!=", "<", ">", "<=", ">=")
        if op:
            return ("cmp", op, left, self.sum())
        negated = self.is_word("NOT") and self.tokens[self.at + 1][1].upper() == "IN"
        if negated:
            self.at += 1
        if self.take_word("IN"):
            self.need_op("(")
            members = []
            while not self.take_op(")"):
                members.append(self.expression())
                self.take_op(",")
            out = ("const", ("lit", "false", BOOLEAN, None))
            for m in members:
                out = ("or", out, ("cmp", "=", left, m))
            return ("not", out) if negated else out
        return left

    def sum(self) -> tuple:
        left = self.product()
        while op := self.take_op("+", "-"):
            left = ("arith", op, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while op := self.take_op("*", "/"):
            left = ("arith", op, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.take_op("!"):
            return ("not", self.unary())
        if self.take_op("-"):
            return ("neg", self.unary())
        if self.take_op("+"):
            return ("call", "+", [self.unary()])
        return self.primary()

    def primary(self) -> tuple:
        if self.take_op("("):
            out = self.expression()
            self.need_op(")")
            return out
        kind, value, at = self.now
        if kind == "var":
            self.at += 1
            return ("var", value[1:])
        if kind == "word" and value.lower() not in ("true", "false"):
            self.at += 1
            name = value.upper()
            if name == "NOT" and self.take_word("EXISTS"):
                return ("exists", True, self.group())
            if name == "EXISTS":
                return ("exists", False, self.group())
            self.need_op("(")
            if name in AGGREGATES:
                return self.aggregate(name)
            args = []
            while not self.take_op(")"):
                args.append(self.expression())
                self.take_op(",")
            return ("call", name, args)
        if kind in ("iri", "pname"):
            name = self.iri_token()
            if self.take_op("("):
                args = []
                while not self.take_op(")"):
                    args.append(self.expression())
                    self.take_op(",")
                return ("call", name, args)
            return ("const", ("iri", name))
        return ("const", self.term())

    def aggregate(self, name: str) -> tuple:
        distinct = bool(self.take_word("DISTINCT"))
        arg = None if self.take_op("*") else self.expression()
        if arg is None and name != "COUNT":
            raise SparqlError(f"{name}(*) is not an aggregate")
        separator = " "
        if self.take_op(";"):
            self.need_word("SEPARATOR")
            self.need_op("=")
            separator = self.term()[1]
        self.need_op(")")
        return ("agg", name, distinct, arg, separator)


def quads_pattern(quads: list):
    """The pattern of the quads of DELETE WHERE."""
    plain = [q[:3] for q in quads if q[3] is None]
    parts: list = [Bgp(plain)] if plain else []
    names: dict = {}
    for q in quads:
        if q[3] is not None:
            names.setdefault(q[3], []).append(q[:3])
    parts += [Graph(g, Bgp(ts)) for g, ts in names.items()]
    return parts[0] if len(parts) == 1 else Join(parts)


def parse(text: str):
    """The request of a SPARQL text."""
    return Parser(text).request()


def pattern_vars(p) -> list[str]:
    """Variables of a pattern in order of first appearance."""
    out: dict[str, None] = {}

    def term(t):
        if t is not None and t[0] == "var":
            out.setdefault(t[1])

    def walk(p):
        if isinstance(p, Bgp):
            for t in p.triples:
                for x in t:
                    term(x)
        elif isinstance(p, PathTriple):
            term(p.subject)
            term(p.object)
        elif isinstance(p, (Join, Union)):
            for x in p.parts:
                walk(x)
        elif isinstance(p, LeftJoin):
            walk(p.left)
            walk(p.right)
        elif isinstance(p, Minus):
            walk(p.left)
        elif isinstance(p, Filter):
            walk(p.inner)
        elif isinstance(p, Extend):
            walk(p.inner)
            out.setdefault(p.var)
        elif isinstance(p, Values):
            for v in p.vars:
                out.setdefault(v)
        elif isinstance(p, SubSelect):
            for v, _ in p.query.items or [(v, None) for v in pattern_vars(p.query.where)]:
                out.setdefault(v)
        elif isinstance(p, Graph):
            term(p.name)
            walk(p.inner)
        elif isinstance(p, Service):
            walk(p.inner)

    walk(p)
    return list(out)


def expr_vars(e: tuple) -> set[str]:
    """Variables that an expression reads."""
    if e[0] == "var":
        return {e[1]}
    if e[0] == "const":
        return set()
    if e[0] == "exists":
        return set(pattern_vars(e[2]))
    out: set[str] = set()
    for x in e[1:]:
        for y in x if isinstance(x, list) else [x]:
            if isinstance(y, tuple) and y and isinstance(y[0], str):
                out |= expr_vars(y)
    return out
