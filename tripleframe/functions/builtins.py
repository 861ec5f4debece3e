"""SPARQL built-in functions as column builders: (values) -> value. Errors are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import XSD
from . import values as V
from .values import Val

DURATION = XSD + "dayTimeDuration"


def _bool(c: Column) -> Val:
    return Val("bool", c)


def _str(c: Column) -> Val:
    return Val("str", c)


def _int(c: Column) -> Val:
    i = c.cast("long")
    return V.number(i, i.cast("double"), True)


def _quoted(text: Column, lang: Column) -> Val:
    """A literal with a language, or a plain one where the language is empty."""
    return Val("nt", F.concat(F.lit('"'), V.escape(text), F.lit('"'), F.when(lang != "", F.concat(F.lit("@"), lang)).otherwise(F.lit(""))))


def _same_lang(v: Val, text: Column) -> Val:
    return _str(text) if v.shape != "nt" else _quoted(text, V.lang_of(v))


def str_(v):
    return _str(V.lexical(v))


def strlen(v):
    return _int(F.char_length(V.lexical(v)))


def _number(whole, near):
    def build(v):
        return V.number(whole(V.int_of(v)), near(V.num_of(v)), v.whole)

    return build


def round_half_away(d: Column) -> Column:
    return F.when(F.abs(d) < 1e15, F.signum(d) * F.floor(F.abs(d) + 0.5).cast("double") + 0.0).otherwise(d)


def substr(v, start, length=None):
    """1-based code points in an XPath window: positions p with start <= p < start + length."""
    text, lo = V.lexical(v), round_half_away(V.num_of(start))
    n = F.char_length(text).cast("double")
    end = n + 1 if length is None else F.least(n + 1, lo + round_half_away(V.num_of(length)))
    first = F.greatest(lo, F.lit(1.0))
    return _same_lang(v, F.when(end <= first, F.when(text.isNotNull() & end.isNotNull(), "")).otherwise(F.substring(text, first.cast("int"), (end - first).cast("int"))))


def strbefore(a, b):
    text, part = V.lexical(a), V.lexical(b)
    at = F.position(part, text)
    return _str(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.when(at == 0, "")))


def strafter(a, b):
    text, part = V.lexical(a), V.lexical(b)
    at = F.position(part, text)
    return _str(F.when(at > 0, F.substring(text, at + F.char_length(part), F.char_length(text))).otherwise(F.when(at == 0, "")))


def concat(*args):
    return _str(F.concat(*[V.lexical(a) for a in args]))


def coalesce(*args):
    shape = V.common(list(args))
    got = [V.reshape(a, shape) for a in args]
    if shape[0] == "num":
        return V.number(F.coalesce(*[g.i for g in got]), F.coalesce(*[g.d for g in got]), got[0].whole)
    return Val(got[0].shape, F.coalesce(*[g.col for g in got]), prefix=got[0].prefix)


def if_(c, a, b):
    test, shape = V.ebv(c), V.common([a, b])
    x, y = V.reshape(a, shape), V.reshape(b, shape)
    pick = lambda p, q: F.when(test, p).when(~test, q)
    if shape[0] == "num":
        return V.number(pick(x.i, y.i), pick(x.d, y.d), x.whole)
    return Val(x.shape, pick(x.col, y.col), prefix=x.prefix)


def _flagged(pattern: Val, flags: Val | None) -> Column:
    text = V.lexical(pattern)
    if flags is None:
        return text
    return F.when(F.contains(V.lexical(flags), F.lit("i")), F.concat(F.lit("(?i)"), text)).otherwise(text)


def regex(text, pattern, flags=None):
    return _bool(F.regexp_like(V.lexical(text), _flagged(pattern, flags)))


def replace(text, pattern, new, flags=None):
    return _same_lang(text, F.regexp_replace(V.lexical(text), _flagged(pattern, flags), V.lexical(new)))


def encode_for_uri(v):
    out = F.url_encode(V.lexical(v))
    for raw, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return _str(out)


def strlang(v, lang):
    return _quoted(V.lexical(v), V.lexical(lang))


def strdt(v, datatype):
    return Val("nt", F.concat(F.lit('"'), V.escape(V.lexical(v)), F.lit('"^^<'), V.iri_of(datatype), F.lit(">")))


def langmatches(tag, wanted):
    t, r = F.lower(V.lexical(tag)), F.lower(V.lexical(wanted))
    return _bool(F.when(r == "*", t != "").otherwise((t == r) | t.startswith(F.concat(r, F.lit("-")))))


def _field(n: int):
    def build(v):
        text = V.moment_text(v)
        got = F.regexp_extract(text, r"^(-?\d{4,})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d))?", n)
        return _int(F.when(got != "", got.try_cast("long")).when(text.isNotNull(), F.lit(0).cast("long")))

    return build


def seconds(v):
    text = V.moment_text(v)
    got = F.regexp_extract(text, r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1)
    got = F.when(got == "", F.when(text.isNotNull(), "00")).otherwise(got)
    part = F.contains(got, F.lit("."))
    return V.number(F.when(~part, got.try_cast("long")), got.try_cast("double"))


def _zone(v) -> Column:
    return F.regexp_extract(V.moment_text(v), r"(Z|[+-]\d\d:\d\d)$", 1)


def tz(v):
    return _str(_zone(v))


def timezone(v):
    z = _zone(v)
    sign = F.when(z.startswith("-"), "-").otherwise("")
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    text = F.when((z == "Z") | ((hours == 0) & (minutes == 0)), "PT0S").when(z != "", F.concat(sign, F.lit("PT"), part(hours, "H"), part(minutes, "M")))
    return Val("nt", F.concat(F.lit('"'), text, F.lit(f'"^^<{DURATION}>')))


def iri(v):
    return Val("iri", F.coalesce(V.iri_of(v), V.text_of(v)))


def bnode(label=None):
    """A fresh blank node, or the one of a label: the same for equal labels."""
    return Val("nt", F.concat(F.lit("_:b"), F.replace(F.uuid(), F.lit("-"), F.lit("")) if label is None else F.substring(F.md5(V.lexical(label)), 1, 16)))


def _hash(build):
    return lambda v: _str(build(V.lexical(v)))


def jaro(s: str, t: str) -> float:
    """A variant of Jaro's similarity: 1 for equal texts, 0 for an empty one, and
    (len(t) / len(s) + 2) / 3 for a shorter text inside the other. Characters match within
    half the shorter text's length less one; two transposed characters count as one swap."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    if len(s) < len(t):
        s, t = t, s
    if t in s:
        return (len(t) / len(s) + 2) / 3
    reach, used, matched = len(t) // 2 - 1, set(), []
    for i, ch in enumerate(s):
        j = next((j for j in range(max(0, i - reach), min(len(t), i + reach + 1)) if j not in used and t[j] == ch), None)
        if j is not None:
            used.add(j)
            matched.append((i, j))
    m = len(matched)
    if not m:
        return 0.0
    other = [t[j] for j in sorted(used)]
    swaps = sum(s[i] != ch for (i, _), ch in zip(matched, other, strict=True)) // 2
    return (m / len(s) + m / len(t) + (m - swaps) / m) / 3


def similarity(a, b):
    @F.pandas_udf("double")
    def run(a, b):
        import pandas as pd

        return pd.Series([None if s is None or t is None else jaro(s, t) for s, t in zip(a, b, strict=True)], dtype="float64")

    return V.number(V.NULL.cast("long"), run(V.lexical(a), V.lexical(b)))


def is_numeric(v):
    return _bool(F.when(V.present(v), V.num_of(v).isNotNull()))


def now():
    return Val("nt", F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(f'Z"^^<{XSD}dateTime>')))


def uuid_iri():
    return Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))


def cast_to(name: str):
    """xsd constructor functions, beyond the required set."""

    def build(v):
        text = V.lexical(v)
        if name == "integer":
            return V.number(F.coalesce(V.int_of(v), V.num_of(v).try_cast("long"), text.try_cast("long")), V.num_of(v), True)
        if name in ("double", "decimal", "float"):
            return V.number(V.NULL.cast("long"), F.coalesce(V.num_of(v), text.try_cast("double")))
        if name == "boolean":
            return _bool(F.coalesce(V.bool_of(v), V.num_of(v) != 0, text.try_cast("boolean")))
        return _str(text)

    return build


BUILTINS = {
    "STR": str_, "STRLEN": strlen, "UCASE": lambda v: _str(F.upper(V.lexical(v))), "LCASE": lambda v: _str(F.lower(V.lexical(v))),
    "ABS": _number(lambda i: F.abs(i), lambda d: F.abs(d)), "CEIL": _number(lambda i: i, lambda d: F.ceil(d).cast("double")), "FLOOR": _number(lambda i: i, lambda d: F.floor(d).cast("double")), "ROUND": _number(lambda i: i, round_half_away),
    "ISNUMERIC": is_numeric, "ISIRI": lambda v: _bool(V.is_iri(v)), "ISURI": lambda v: _bool(V.is_iri(v)), "ISBLANK": lambda v: _bool(V.is_blank(v)), "ISLITERAL": lambda v: _bool(V.is_literal(v)),
    "LANG": lambda v: _str(V.lang_of(v)), "DATATYPE": lambda v: Val("iri", V.datatype_of(v)),
    "CONTAINS": lambda a, b: _bool(F.contains(V.lexical(a), V.lexical(b))), "STRSTARTS": lambda a, b: _bool(F.startswith(V.lexical(a), V.lexical(b))), "STRENDS": lambda a, b: _bool(F.endswith(V.lexical(a), V.lexical(b))),
    "STRBEFORE": strbefore, "STRAFTER": strafter, "CONCAT": concat, "COALESCE": coalesce, "REGEX": regex, "SUBSTR": substr, "REPLACE": replace, "ENCODE_FOR_URI": encode_for_uri,
    "STRLANG": strlang, "STRDT": strdt, "LANGMATCHES": langmatches, "SIMILARITY": similarity, "SAMETERM": lambda a, b: _bool(V.to_nt(a) == V.to_nt(b)),
    "RAND": lambda: V.number(V.NULL.cast("long"), F.rand()), "UUID": uuid_iri, "STRUUID": lambda: _str(F.uuid()), "NOW": now,
    "YEAR": _field(1), "MONTH": _field(2), "DAY": _field(3), "HOURS": _field(4), "MINUTES": _field(5), "SECONDS": seconds, "TIMEZONE": timezone, "TZ": tz,
    "IRI": iri, "URI": iri, "BNODE": bnode, "IF": if_, "MD5": _hash(F.md5), "SHA1": _hash(F.sha1), "SHA256": _hash(lambda c: F.sha2(c, 256)), "SHA384": _hash(lambda c: F.sha2(c, 384)), "SHA512": _hash(lambda c: F.sha2(c, 512)),
    "+": lambda v: V.number(V.int_of(v), V.num_of(v), v.whole),
} | {XSD + n: cast_to(n) for n in ("integer", "double", "decimal", "float", "boolean", "string")}

#: Functions whose result differs from call to call: their queries are not cached.
VOLATILE = {"RAND", "UUID", "STRUUID", "NOW", "BNODE"}


class Registry:
    """User functions by name, upper case. A function takes and returns ``Val``s, or, with
    ``register_udf``, is a Python function over the lexical forms, run as a pandas UDF."""

    def __init__(self):
        self.own: dict = {}

    def register(self, name: str, build) -> None:
        self.own[name.upper()] = build

    def register_udf(self, name: str, function, returns: str = "string") -> None:
        @F.pandas_udf(returns)
        def run(*columns):
            import pandas as pd

            return pd.Series([None if any(x is None for x in row) else function(*row) for row in zip(*columns, strict=True)])

        def build(*args):
            got = run(*[V.lexical(a) for a in args])
            if returns == "string":
                return _str(got)
            if returns == "boolean":
                return _bool(got)
            return V.number(got.cast("long") if returns in ("long", "int") else V.NULL.cast("long"), got.cast("double"), returns in ("long", "int"))

        self.register(name, build)

    def find(self, name: str):
        return BUILTINS.get(name) or BUILTINS.get(name.upper()) or self.own.get(name.upper())
