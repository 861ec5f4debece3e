"""Forward chaining: RDFS closure and user rules, as joins to a fixpoint."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from ..terms import RDFS, TYPE
from .paths import transitive

SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, A = (f"<{x}>" for x in (RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", TYPE))


def _pairs(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias("a"), F.col("o").alias("b"))


def _closed(triples: DataFrame, predicate: str) -> DataFrame:
    """The transitive closure of a schema predicate, without (x, x)."""
    return transitive(_pairs(triples, predicate)).where("a <> b")


def rdfs_closure(triples: DataFrame, literal_subjects: bool = True) -> DataFrame:
    """New triples (s, p, o) by subclass, subproperty, domain and range; types are
    given to literals too unless ``literal_subjects`` is false.

    Each round closes the schema, moves triples up the property hierarchy, derives
    types from domains and ranges and moves types up the classes; a second round is
    needed only if one of these adds to the schema itself.
    """
    base = triples.select("s", "p", "o").distinct()
    known = written(base, "rdfs")
    size = known.count()
    while True:
        classes, properties = _closed(known, SUB_CLASS), _closed(known, SUB_PROPERTY)
        up = known.join(properties, F.col("p") == F.col("a")).select("s", F.col("b").alias("p"), "o")
        data = written(known.unionAll(up).unionAll(classes.select(F.col("a").alias("s"), F.lit(SUB_CLASS).alias("p"), F.col("b").alias("o"))).unionAll(properties.select(F.col("a").alias("s"), F.lit(SUB_PROPERTY).alias("p"), F.col("b").alias("o"))).distinct(), "rdfs")
        domain = data.join(_pairs(data, DOMAIN), F.col("p") == F.col("a")).select("s", F.col("b").alias("c"))
        range_ = data.join(_pairs(data, RANGE), F.col("p") == F.col("a")).select(F.col("o").alias("s"), F.col("b").alias("c"))
        if not literal_subjects:
            range_ = range_.where(~F.col("s").startswith('"'))
        types = domain.unionAll(range_).unionAll(data.where(F.col("p") == A).select("s", F.col("o").alias("c"))).distinct()
        higher = types.join(classes, F.col("c") == F.col("a")).select("s", F.col("b").alias("c"))
        types = types.unionAll(higher).select("s", F.lit(A).alias("p"), F.col("c").alias("o"))
        known = written(data.unionAll(types).distinct(), "rdfs")
        now = known.count()
        if now == size:
            break
        size = now
    return known.join(base, ["s", "p", "o"], "left_anti")


@dataclass
class Rule:
    """``?x <p> ?y . ?y <q> ?z => ?x <r> ?z``"""

    name: str
    text: str
    body: list
    head: tuple
    enabled: bool = True
    effect_count: int = 0

    @classmethod
    def parse(cls, name: str, text: str) -> Rule:
        sides = text.split("=>")
        if len(sides) != 2:
            raise ValueError("a rule needs one =>")
        body, head = _patterns(sides[0]), _patterns(sides[1])
        if not body or len(head) != 1:
            raise ValueError("a rule needs a body and one head")
        missing = {t for t in head[0] if t.startswith("?")} - {t for p in body for t in p}
        if missing:
            raise ValueError(f"not in the body: {', '.join(sorted(missing))}")
        return cls(name, text, body, head[0])

    def derive(self, triples: DataFrame) -> DataFrame:
        """Distinct triples that the rule derives; literal subjects are dropped."""
        out = None
        for pattern in self.body:
            part, names = triples, {}
            for column, term in zip("spo", pattern, strict=True):
                if not term.startswith("?"):
                    part = part.where(F.col(column) == term)
                elif term in names:
                    part = part.where(F.col(names[term]) == F.col(column))
                else:
                    names[term] = column
            part = part.select(*[F.col(c).alias(f"v_{t[1:]}") for t, c in names.items()]) if names else part.limit(1).select(F.lit(1).alias("v_"))
            shared = [] if out is None else [c for c in part.columns if c in out.columns]
            out = part if out is None else out.join(part, shared) if shared else out.crossJoin(part)
        columns = [F.col(f"v_{t[1:]}") if t.startswith("?") else F.lit(t) for t in self.head]
        return out.select(*[c.alias(n) for c, n in zip(columns, "spo", strict=True)]).where(~F.col("s").startswith('"')).distinct()


TERM = re.compile(r'\s*(\?\w+|<[^>]*>|_:\w+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)')


def _patterns(text: str) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while text[at:].strip():
        terms = []
        for _ in range(3):
            m = TERM.match(text, at)
            if m is None:
                raise ValueError(f"expected a term in rule at {text[at : at + 20]!r}")
            terms.append(m[1])
            at = m.end()
        if not terms[1].startswith("<"):
            raise ValueError("the predicate of a rule must be an IRI")
        out.append(tuple(terms))
        at += len(text[at:]) - len(text[at:].lstrip(" \t\n."))
    return out


def apply_rules(triples: DataFrame, rules: list[Rule]) -> DataFrame:
    """All enabled rules to their joint fixpoint; a rule sees what earlier ones added in
    the same round. Returns the new triples and sets each rule's ``effect_count``."""
    base = known = written(triples.select("s", "p", "o").distinct(), "rules")
    for rule in rules:
        rule.effect_count = 0
    changed = True
    while changed:
        changed = False
        for rule in rules:
            if not rule.enabled:
                continue
            new = written(rule.derive(known).join(known, ["s", "p", "o"], "left_anti"), "rules")
            n = new.count()
            if n:
                rule.effect_count += n
                known = known.unionAll(new)
                changed = True
    return known.join(base, ["s", "p", "o"], "left_anti")
