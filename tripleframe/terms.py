"""RDF terms: Python tuples on the driver, canonical N-Triples strings in columns.

A term is ("iri", text), ("blank", label), ("lit", lexical, datatype, lang) or,
in patterns, ("var", name). The canonical string identifies a term, so joins and
grouping on terms are joins and grouping on one string column.
"""

from __future__ import annotations

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
TYPE = RDF + "type"
INTEGER, DOUBLE, DECIMAL, BOOLEAN, STRING = (XSD + x for x in ("integer", "double", "decimal", "boolean", "string"))

_OUT = str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"})
_IN = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "'": "'"}


def iri(text: str) -> tuple:
    return ("iri", text)


def lit(value, datatype: str | None = None, lang: str | None = None) -> tuple:
    if isinstance(value, bool):
        return ("lit", str(value).lower(), BOOLEAN, None)
    if isinstance(value, int):
        return ("lit", str(value), INTEGER, None)
    if isinstance(value, float):
        return ("lit", repr(value), DOUBLE, None)
    return ("lit", value, datatype, lang)


def nt(term: tuple) -> str:
    """The canonical N-Triples form."""
    if term[0] == "iri":
        return f"<{term[1]}>"
    if term[0] == "blank":
        return f"_:{term[1]}"
    _, lexical, datatype, lang = term
    quoted = f'"{lexical.translate(_OUT)}"'
    return f"{quoted}@{lang}" if lang else f"{quoted}^^<{datatype}>" if datatype else quoted


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        ch = text[i]
        if ch != "\\" or i + 1 == len(text):
            out.append(ch)
            i += 1
            continue
        code = text[i + 1]
        if code in "uU":
            n = 4 if code == "u" else 8
            out.append(chr(int(text[i + 2 : i + 2 + n], 16)))
            i += 2 + n
        else:
            out.append(_IN.get(code, code))
            i += 2
    return "".join(out)


def from_nt(text: str) -> tuple:
    """The term of a canonical string."""
    if text.startswith("<"):
        return ("iri", text[1:-1])
    if text.startswith("_:"):
        return ("blank", text[2:])
    end = text.rindex('"')
    tail = text[end + 1 :]
    lexical = unescape(text[1:end])
    if tail.startswith("@"):
        return ("lit", lexical, None, tail[1:])
    return ("lit", lexical, tail[3:-1] if tail.startswith("^^<") else None, None)
