"""Substring and prefix search over the terms of a store.

``trigram_index`` is an optional table (gram, term); a search joins the grams of
the needle and checks the candidates, so it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def terms_of(quads: DataFrame) -> DataFrame:
    """Distinct subjects and objects: term, text (without brackets, quotes and suffixes)."""
    term = quads.select(F.col("s").alias("term")).unionAll(quads.select("o")).distinct()
    return term.withColumn("text", F.regexp_replace("term", r'(?s)^(?:<(.*)>|"(.*)"(?:@[^"]*|\^\^<[^"]*>)?|_:(.*))$', "$1$2$3"))


def trigram_index(terms: DataFrame) -> DataFrame:
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text") - 2, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(3))))
    return terms.select("term", "text", F.explode(grams).alias("gram"))


def contains(terms: DataFrame, needle: str, index: DataFrame | None = None) -> DataFrame:
    """Terms whose text holds the needle."""
    if index is None or len(needle) < 3:
        return terms.where(F.contains("text", F.lit(needle))).select("term", "text")
    grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    found = index.where(F.col("gram").isin(grams)).groupBy("term", "text").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return found.where(F.contains("text", F.lit(needle))).select("term", "text")


def prefix(terms: DataFrame, start: str) -> DataFrame:
    return terms.where(F.startswith("text", F.lit(start))).select("term", "text")
