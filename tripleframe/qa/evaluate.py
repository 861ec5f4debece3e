"""Datasets of questions and set-based scores."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Question:
    id: str
    text: str
    gold: set
    query: str | None = None


def prf1(predicted: set, gold: set) -> tuple[float, float, float]:
    """Precision, recall and F1; both empty are 1, one empty is 0."""
    if not predicted and not gold:
        return 1.0, 1.0, 1.0
    if not predicted or not gold:
        return 0.0, 0.0, 0.0
    hit = len(predicted & gold)
    p, r = hit / len(predicted), hit / len(gold)
    return p, r, 2 * p * r / (p + r) if hit else 0.0


def prf1_frame(predicted: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: precision, recall, f1 of the sets of values."""
    p, g = predicted.select(key, value).distinct().withColumn("p", F.lit(1)), gold.select(key, value).distinct().withColumn("g", F.lit(1))
    sums = p.join(g, [key, value], "full_outer").groupBy(key).agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("hit"))
    precision, recall = F.when(F.col("np") > 0, F.col("hit") / F.col("np")).otherwise(0.0), F.when(F.col("ng") > 0, F.col("hit") / F.col("ng")).otherwise(0.0)
    f1 = F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("np") + F.col("ng"))).otherwise(0.0)
    return sums.select(key, precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def load_qald(text: str, language: str = "en") -> list[Question]:
    out = []
    for q in json.loads(text)["questions"]:
        asked = next((x["string"] for x in q["question"] if x.get("language") == language), q["question"][0]["string"])
        gold = set()
        for answer in q.get("answers", []):
            if "boolean" in answer:
                gold.add(str(answer["boolean"]).lower())
            gold |= {cell["value"] for row in answer.get("results", {}).get("bindings", []) for cell in row.values()}
        out.append(Question(str(q["id"]), asked, gold, q.get("query", {}).get("sparql")))
    return out


def load_lcquad(text: str) -> list[Question]:
    return [Question(str(q["_id"]), q["corrected_question"], set(), q["sparql_query"]) for q in json.loads(text)]


def evaluate(solver, questions: list[Question]) -> dict:
    """Macro averages over the questions; gold answers come from the gold query where there are none."""
    from ..terms import from_nt
    from .solve import run_query

    plain = lambda rows: {str(r).lower() if isinstance(r, bool) else from_nt(c)[1] for r in rows for c in ([None] if isinstance(r, bool) else r) if isinstance(r, bool) or c}
    scores = []
    for q in questions:
        gold = q.gold or (plain(run_query(solver.store, q.query)) if q.query else set())
        answer = solver.ask(q.text, "structured")
        scores.append(prf1(plain([r for r in answer.answers if isinstance(r, (tuple, bool))]), gold))
    mean = [sum(s[k] for s in scores) / len(scores) if scores else 0.0 for k in range(3)]
    return {"questions": len(scores), "precision": mean[0], "recall": mean[1], "f1": mean[2]}
