"""SPARQL result formats, the text table, and the HTTP client of SERVICE.

Writers take a frame whose cells are canonical N-Triples strings and go through
``toLocalIterator``, one row at a time.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from ..terms import from_nt

TYPES = {"json": "application/sparql-results+json", "xml": "application/sparql-results+xml", "csv": "text/csv", "tsv": "text/tab-separated-values"}


def negotiate(param: str | None = None, accept: str | None = None) -> str:
    """The format parameter, else the Accept header, else JSON."""
    for text in (param, accept):
        for part in (text or "").lower().split(","):
            name = part.split(";")[0].strip()
            for fmt, mime in TYPES.items():
                if name in (fmt, mime, f"application/{fmt}", f"text/{fmt}"):
                    return fmt
    return "json"


def json_cell(cell: str) -> dict:
    t = from_nt(cell)
    if t[0] == "iri":
        return {"type": "uri", "value": t[1]}
    if t[0] == "blank":
        return {"type": "bnode", "value": t[1]}
    out = {"type": "literal", "value": t[1]}
    return out | ({"xml:lang": t[3]} if t[3] else {"datatype": t[2]} if t[2] else {})


def plain(cell: str | None) -> str:
    if cell is None:
        return ""
    t = from_nt(cell)
    return f"_:{t[1]}" if t[0] == "blank" else t[1]


def csv_cell(cell: str | None) -> str:
    text = plain(cell)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def lines_of_select(df: DataFrame, fmt: str):
    """Pieces of the document, a row each."""
    names, rows = df.columns, (tuple(r) for r in df.toLocalIterator())
    if fmt == "json":
        yield '{"head":{"vars":' + json.dumps(names) + '},"results":{"bindings":['
        for k, row in enumerate(rows):
            yield ("," if k else "") + json.dumps({n: json_cell(c) for n, c in zip(names, row, strict=True) if c is not None}, ensure_ascii=False)
        yield "]}}"
    elif fmt == "xml":
        yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head><results>"
        for row in rows:
            out = []
            for n, c in zip(names, row, strict=True):
                if c is None:
                    continue
                t = from_nt(c)
                if t[0] == "lit":
                    more = f" xml:lang={quoteattr(t[3])}" if t[3] else f" datatype={quoteattr(t[2])}" if t[2] else ""
                    inner = f"<literal{more}>{escape(t[1])}</literal>"
                else:
                    tag = "uri" if t[0] == "iri" else "bnode"
                    inner = f"<{tag}>{escape(t[1])}</{tag}>"
                out.append(f"<binding name={quoteattr(n)}>{inner}</binding>")
            yield "<result>" + "".join(out) + "</result>"
        yield "</results></sparql>"
    elif fmt == "csv":
        yield ",".join(names) + "\r\n"
        for row in rows:
            yield ",".join(map(csv_cell, row)) + "\r\n"
    elif fmt == "tsv":
        yield "\t".join(f"?{n}" for n in names) + "\n"
        for row in rows:
            yield "\t".join(c or "" for c in row) + "\n"
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_select(df: DataFrame, fmt: str, out) -> None:
    for piece in lines_of_select(df, fmt):
        out.write(piece)


def ask_text(value: bool, fmt: str) -> str:
    word = str(value).lower()
    if fmt == "xml":
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{word}</boolean></sparql>'
    return '{"head":{},"boolean":' + word + "}" if fmt == "json" else word + "\n"


def table_text(df: DataFrame, limit: int = 1000) -> str:
    """A padded table with a header of ?variables."""
    rows = [[f"?{n}" for n in df.columns], *([c or "" for c in r] for r in df.limit(limit).collect())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows) + "\n"


def parse_json(text: str) -> list[dict]:
    """Rows of terms by variable from SPARQL JSON results."""
    out = []
    for binding in json.loads(text)["results"]["bindings"]:
        row = {}
        for name, c in binding.items():
            kind = {"uri": "iri", "bnode": "blank"}.get(c["type"])
            row[name] = (kind, c["value"]) if kind else ("lit", c["value"], c.get("datatype"), c.get("xml:lang"))
        out.append(row)
    return out


def http_service(endpoint: str, query: str, timeout: float = 15.0) -> list[dict]:
    """The default transport of SERVICE: POST, JSON results, plain http only."""
    if not endpoint.startswith("http://"):
        raise ValueError("only http:// endpoints are supported")
    body = urllib.parse.urlencode({"query": query}).encode()
    request = urllib.request.Request(endpoint, body, {"Accept": TYPES["json"], "Content-Type": "application/x-www-form-urlencoded"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return parse_json(answer.read().decode())

