"""Typed views of terms as Spark columns.

A ``Val`` is a term-valued column whose shape is known when the plan is built:

* ``nt``      any term, as canonical N-Triples string
* ``iri``     IRI text; ``key`` an IRI template: prefix + key column
* ``num``     number: ``i`` (BIGINT, null unless an integer) and ``d`` (DOUBLE)
* ``bool``, ``str`` (plain literal), ``time`` (TIMESTAMP, an xsd:dateTime)

Everything compiles to built-in expressions; an error is NULL. A native shape
costs what a plain column costs, so filters on it reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import BOOLEAN, DOUBLE, INTEGER, RDF, STRING, XSD, nt

INTS = [XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")]
FLOATS = [XSD + x for x in ("decimal", "double", "float")]
TIMES = [XSD + x for x in ("dateTime", "date")]
LANG_STRING = RDF + "langString"
MOMENT = r"^-?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$"


class _Null:
    """F.lit(None), made when used: a column needs a session."""

    def cast(self, kind: str) -> Column:
        return F.lit(None).cast(kind)


NULL = _Null()


@dataclass
class Val:
    shape: str
    col: Column | None = None  # nt, iri, key, bool, str, time
    i: Column | None = None  # num
    d: Column | None = None  # num
    prefix: str = ""  # key
    whole: bool | str = False  # num: statically an integer; "wide" if an overflow may have left ``d`` alone
    fixed: tuple | None = None  # the term, if constant


def null_val() -> Val:
    return Val("nt", NULL.cast("string"))


def const(term: tuple) -> Val:
    if term[0] == "iri":
        return Val("iri", F.lit(term[1]), fixed=term)
    if term[0] == "lit":
        _, lexical, datatype, lang = term
        try:
            if datatype in INTS and abs(int(lexical)) < 2**63:
                return Val("num", i=F.lit(int(lexical)).cast("long"), d=F.lit(float(lexical)), whole=True, fixed=term)
            if datatype in FLOATS:
                return Val("num", i=NULL.cast("long"), d=F.lit(float(lexical)), fixed=term)
        except ValueError:
            pass
        if datatype == BOOLEAN and lexical in ("true", "false", "1", "0"):
            return Val("bool", F.lit(lexical in ("true", "1")), fixed=term)
        if not lang and datatype in (None, STRING):
            return Val("str", F.lit(lexical), fixed=term)
    return Val("nt", F.lit(nt(term)), fixed=term)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def format_double(x: Column) -> Column:
    """Text of a double: ``x.0`` for integral values, else the shortest digits without exponent."""
    plain = F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), special).when((x == F.floor(x)) & (F.abs(x) < 1e15), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(F.coalesce(plain, x.cast("string")))


def stamp(ts: Column) -> Column:
    """Lexical xsd:dateTime of a timestamp."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def to_nt(v: Val) -> Column:
    if v.fixed is not None:
        return F.lit(nt(v.fixed))
    if v.shape == "nt":
        return v.col
    if v.shape == "iri":
        return F.concat(F.lit("<"), v.col, F.lit(">"))
    if v.shape == "key":
        return F.concat(F.lit("<" + v.prefix), v.col.cast("string"), F.lit(">"))
    if v.shape == "num":
        whole = F.concat(F.lit('"'), v.i.cast("string"), F.lit(f'"^^<{INTEGER}>'))
        return whole if v.whole is True else F.coalesce(whole, F.concat(F.lit('"'), format_double(v.d), F.lit(f'"^^<{DOUBLE}>')))
    if v.shape == "bool":
        return F.concat(F.lit('"'), v.col.cast("string"), F.lit(f'"^^<{BOOLEAN}>'))
    if v.shape == "time":
        return F.concat(F.lit('"'), stamp(v.col), F.lit(f'"^^<{XSD}dateTime>'))
    return F.concat(F.lit('"'), escape(v.col), F.lit('"'))


def present(v: Val) -> Column:
    """Whether the value is bound."""
    if v.shape == "num":
        return v.d.isNotNull() if v.whole is not True else v.i.isNotNull() | v.d.isNotNull()
    return v.col.isNotNull()


# --- parts of a canonical string


def _literal(c: Column) -> Column:
    return c.startswith('"')


def _body(c: Column) -> Column:
    """Between the quotes, escapes as written."""
    return F.regexp_extract(c, r'(?s)^"(.*)"', 1)


def _lexical(c: Column) -> Column:
    body = _body(c)
    plain = F.replace(body, F.lit("\\\\"), F.lit("\x01"))
    for code, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        plain = F.replace(plain, F.lit(code), F.lit(raw))
    return F.when(F.contains(body, F.lit("\\")), F.replace(plain, F.lit("\x01"), F.lit("\\"))).otherwise(body)


def _datatype(c: Column) -> Column:
    return F.regexp_extract(c, r'"\^\^<([^"]*)>$', 1)


def _lang(c: Column) -> Column:
    return F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1)


def int_of(v: Val) -> Column:
    """BIGINT of an integer, else null."""
    if v.shape == "num":
        return v.i
    if v.shape != "nt":
        return NULL.cast("long")
    return F.when(_datatype(v.col).isin(INTS), _body(v.col).try_cast("long"))


def num_of(v: Val) -> Column:
    """DOUBLE of a number, else null."""
    if v.shape == "num":
        return F.coalesce(v.d, v.i.cast("double")) if v.whole is not True else v.i.cast("double")
    if v.shape != "nt":
        return NULL.cast("double")
    dt = _datatype(v.col)
    return F.when(dt.isin(FLOATS + INTS), F.when(dt.isin(FLOATS) | _body(v.col).try_cast("long").isNotNull(), _body(v.col).try_cast("double")))


def bool_of(v: Val) -> Column:
    if v.shape == "bool":
        return v.col
    if v.shape != "nt":
        return NULL.cast("boolean")
    lex = _body(v.col)
    return F.when(_datatype(v.col) == BOOLEAN, F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))


def text_of(v: Val) -> Column:
    """Value of a plain, language-tagged or xsd:string literal, else null."""
    if v.shape == "str":
        return v.col
    if v.shape != "nt":
        return NULL.cast("string")
    return F.when(_literal(v.col) & _datatype(v.col).isin("", STRING), _lexical(v.col))


def lang_of(v: Val) -> Column:
    """Language tag, "" without one; null for an unbound value."""
    if v.shape == "nt":
        return _lang(v.col)
    return F.when(present(v), F.lit(""))


def iri_of(v: Val) -> Column:
    if v.shape == "iri":
        return v.col
    if v.shape == "key":
        return F.concat(F.lit(v.prefix), v.col.cast("string"))
    if v.shape != "nt":
        return NULL.cast("string")
    return F.when(v.col.startswith("<"), F.substring(v.col, 2, F.length(v.col) - 2))


def is_blank(v: Val) -> Column:
    return v.col.startswith("_:") if v.shape == "nt" else F.when(present(v), F.lit(False))


def is_iri(v: Val) -> Column:
    return v.col.startswith("<") if v.shape == "nt" else F.when(present(v), F.lit(v.shape in ("iri", "key")))


def is_literal(v: Val) -> Column:
    return _literal(v.col) if v.shape == "nt" else F.when(present(v), F.lit(v.shape not in ("iri", "key")))


def lexical(v: Val) -> Column:
    """STR(): the text of any term; numbers are rendered anew."""
    if v.shape in ("iri", "key"):
        return iri_of(v)
    if v.shape == "num":
        return v.i.cast("string") if v.whole is True else F.coalesce(v.i.cast("string"), format_double(v.d))
    if v.shape == "bool":
        return v.col.cast("string")
    if v.shape == "time":
        return stamp(v.col)
    if v.shape == "str":
        return v.col
    c = v.col
    return F.when(c.startswith("<"), F.substring(c, 2, F.length(c) - 2)).when(c.startswith("_:"), F.substring(c, 3, F.length(c))).otherwise(F.coalesce(int_of(v).cast("string"), F.when(_datatype(c).isin(FLOATS), format_double(num_of(v))), bool_of(v).cast("string"), _lexical(c)))


def raw_lexical(v: Val) -> Column:
    """The text as written, for native results."""
    if v.shape != "nt":
        return lexical(v)
    c = v.col
    return F.when(c.startswith("<"), F.substring(c, 2, F.length(c) - 2)).when(c.startswith("_:"), c).otherwise(_lexical(c))


def moment_text(v: Val) -> Column:
    """Lexical form of a dateTime or date, else null."""
    if v.shape == "time":
        return stamp(v.col)
    if v.shape != "nt":
        return NULL.cast("string")
    lex = _body(v.col)
    return F.when(_datatype(v.col).isin(TIMES) & F.regexp_like(lex, F.lit(MOMENT)), lex)


def instant(v: Val) -> Column:
    """Seconds since 1970 in UTC; a missing zone means UTC."""
    if v.shape == "time":
        return F.unix_micros(v.col) / 1e6
    text = moment_text(v)
    full = F.when(F.contains(text, F.lit("T")), text).otherwise(F.regexp_replace(text, r"^(-?\d{4,}-\d\d-\d\d)", "$1T00:00:00"))
    zoned = F.when(F.regexp_like(full, F.lit(r"(Z|[+-]\d\d:\d\d)$")), full).otherwise(F.concat(full, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp")) / 1e6


def datatype_of(v: Val) -> Column:
    """DATATYPE(): IRI text; integers and decimals by their runtime type."""
    if v.shape == "num":
        return F.when(v.i.isNotNull(), INTEGER).when(v.d.isNotNull(), DOUBLE)
    fixed = {"bool": BOOLEAN, "str": STRING, "time": XSD + "dateTime"}.get(v.shape)
    if fixed:
        return F.when(v.col.isNotNull(), fixed)
    if v.shape != "nt":
        return NULL.cast("string")
    dt = _datatype(v.col)
    return F.when(~_literal(v.col), F.lit(None)).when(int_of(v).isNotNull(), INTEGER).when(num_of(v).isNotNull(), DOUBLE).when(_lang(v.col) != "", LANG_STRING).when(dt == "", STRING).otherwise(dt)


# --- kinds

NUMBER, BOOL, TEXT, TIME, IRI, BLANK, TYPED = 3, 4, 5, 6, 2, 1, 7
STATIC = {"num": NUMBER, "bool": BOOL, "str": TEXT, "time": TIME, "iri": IRI, "key": IRI}


def kind(v: Val) -> int | Column:
    if v.shape != "nt":
        return STATIC[v.shape]
    c = v.col
    return F.when(c.isNull(), F.lit(None)).when(c.startswith("<"), IRI).when(c.startswith("_:"), BLANK).when(text_of(v).isNotNull(), TEXT).when(num_of(v).isNotNull(), NUMBER).when(bool_of(v).isNotNull(), BOOL).when(instant(v).isNotNull(), TIME).otherwise(TYPED)


def same_term(a: Val, b: Val) -> Column:
    if a.shape == b.shape == "key":
        return a.col == b.col if a.prefix == b.prefix else iri_of(a) == iri_of(b)
    if a.shape == b.shape and a.shape in ("str", "bool", "time", "iri"):
        return a.col == b.col
    if a.shape == "key" and b.fixed is not None and b.shape == "iri":
        return key_equals(a, b.fixed[1])
    if b.shape == "key" and a.fixed is not None and a.shape == "iri":
        return key_equals(b, a.fixed[1])
    if a.shape == b.shape == "num" and a.whole is True and b.whole is True:
        return a.i == b.i
    return to_nt(a) == to_nt(b)


def key_equals(v: Val, text: str) -> Column:
    """Compares the key column itself with the constant's key, so that the test is pushed down."""
    if not text.startswith(v.prefix):
        return F.when(v.col.isNotNull(), F.lit(False))
    key = text[len(v.prefix) :]
    return v.col == (F.lit(int(key)) if key.isdigit() else F.lit(key))


def _both(a: Val, b: Val, want: int) -> Column | bool:
    ka, kb = kind(a), kind(b)
    if isinstance(ka, int) and isinstance(kb, int):
        return ka == kb == want
    out = None
    for k in (ka, kb):
        if isinstance(k, int):
            if k != want:
                return False
        else:
            out = (k == want) if out is None else out & (k == want)
    return out


def _cases(a: Val, b: Val, cases: list) -> Column:
    """CASE over the common kind of both; different kinds are an error (null)."""
    out = None
    for want, build in cases:
        test = _both(a, b, want)
        if test is False:
            continue
        if test is True:
            return build()
        out = (F if out is None else out).when(test, build())
    return NULL.cast("boolean") if out is None else out


def _number_test(a: Val, b: Val, test) -> Column:
    exact = test(int_of(a), int_of(b))
    if a.shape == b.shape == "num" and a.whole is True and b.whole is True:
        return exact
    near = test(num_of(a), num_of(b))
    if (a.shape == "num" and not a.whole and a.fixed) or (b.shape == "num" and not b.whole and b.fixed):
        return near
    return F.coalesce(exact, near)


def equal(a: Val, b: Val) -> Column:
    if a.shape == b.shape and a.shape in ("str", "bool", "time"):
        return a.col == b.col
    return _cases(a, b, [
        (NUMBER, lambda: _number_test(a, b, lambda x, y: x == y)), (TIME, lambda: instant(a) == instant(b)), (TEXT, lambda: (text_of(a) == text_of(b)) & (lang_of(a) == lang_of(b))),
        (BOOL, lambda: bool_of(a) == bool_of(b)), (IRI, lambda: same_term(a, b)), (BLANK, lambda: to_nt(a) == to_nt(b)), (TYPED, lambda: to_nt(a) == to_nt(b)),
    ])


ORDERS = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}


def _as_time(v: Val) -> Val:
    """A constant dateTime as a native timestamp, for comparison with a column of that type."""
    return Val("time", F.lit(v.fixed[1]).try_cast("timestamp")) if v.fixed and v.fixed[0] == "lit" and v.fixed[2] in TIMES else v


def compare(op: str, a: Val, b: Val) -> Column:
    if op in ("=", "!="):
        if a.shape == "time" or b.shape == "time":
            a, b = _as_time(a), _as_time(b)
        return equal(a, b) if op == "=" else ~equal(a, b)
    test = ORDERS[op]
    if "time" in (a.shape, b.shape):
        a, b = _as_time(a), _as_time(b)
        if a.shape == b.shape:
            return test(a.col, b.col)
    return _cases(a, b, [(NUMBER, lambda: _number_test(a, b, test)), (TIME, lambda: test(instant(a), instant(b))), (TEXT, lambda: test(text_of(a), text_of(b))), (BOOL, lambda: test(bool_of(a).cast("int"), bool_of(b).cast("int"))), (IRI, lambda: test(iri_of(a), iri_of(b)))])


def ebv(v: Val) -> Column:
    """Effective boolean value: null is an error."""
    if v.shape == "bool":
        return v.col
    if v.shape == "num":
        return (v.i != 0) if v.whole is True else F.coalesce(v.i != 0, (v.d != 0) & ~F.isnan(v.d))
    if v.shape == "str":
        return v.col != ""
    if v.shape == "nt":
        return F.coalesce(bool_of(v), int_of(v) != 0, (num_of(v) != 0) & ~F.isnan(num_of(v)), text_of(v) != "")
    return NULL.cast("boolean")


def number(i: Column, d: Column, whole: bool | str = False) -> Val:
    return Val("num", i=i, d=d, whole=whole)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Integers stay exact; an overflow goes on as double; / is always double; errors are null."""
    x, y = num_of(a), num_of(b)
    if op == "/":
        return number(NULL.cast("long"), F.try_divide(x, y))
    exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](int_of(a), int_of(b))
    return number(exact, {"+": x + y, "-": x - y, "*": x * y}[op], "wide" if a.whole and b.whole else False)


def negate(v: Val) -> Val:
    return number(F.try_subtract(F.lit(0).cast("long"), int_of(v)), -num_of(v), "wide" if v.whole else False)


def order_struct(v: Val) -> Column:
    """Total order of terms: unbound, blank, IRI, number, boolean, other literal, time."""
    if v.shape in ("str", "key", "iri", "bool", "time"):
        return v.col
    if v.shape == "num":
        return v.i if v.whole is True else num_of(v)
    c = v.col

    def key(group, n=None, i=None, t=None):
        empty = lambda x, kind: F.lit(None).cast(kind) if x is None else x
        return F.struct(F.lit(group).alias("g"), empty(n, "double").alias("n"), empty(i, "long").alias("i"), empty(t, "string").alias("t"))

    return (
        F.when(c.isNull(), key(0)).when(c.startswith("_:"), key(1, t=c)).when(c.startswith("<"), key(2, t=c)).when(num_of(v).isNotNull(), key(NUMBER, num_of(v), int_of(v)))
        .when(bool_of(v).isNotNull(), key(BOOL, bool_of(v).cast("double"))).when(instant(v).isNotNull(), key(TIME, instant(v))).otherwise(key(TEXT, t=_body(c)))
    )


def lift(v: Val) -> Val:
    return Val("nt", to_nt(v))


def common(vals: list[Val]) -> str | tuple:
    """The shape that all can have without loss: ("key", prefix), a native shape, or nt."""
    shapes = {(v.shape, v.prefix) if v.shape == "key" else (v.shape, v.whole) if v.shape == "num" else (v.shape, "") for v in vals}
    if len(shapes) == 1:
        return next(iter(shapes))
    if {s for s, _ in shapes} == {"num"}:
        return ("num", False if ("num", False) in shapes else "wide")
    if {s for s, _ in shapes} <= {"iri", "key"}:
        return ("iri", "")
    return ("nt", "")


def reshape(v: Val, shape: tuple) -> Val:
    if shape[0] == "nt":
        return lift(v)
    if shape[0] == "iri":
        return Val("iri", iri_of(v))
    return number(v.i, num_of(v), shape[1]) if shape[0] == "num" else v
