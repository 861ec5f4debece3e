"""A corpus pipeline of four stages: language ID, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept
and, but for the last, returns them with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.llm import decontaminate, langid, near_dups, packing
from tripleframe.llm.common import anti_join, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the stage's own documents that are not held out; rejects texts
    without a letter (or null). Where no language could be learnt, the others stay."""
    model = langid.train(docs)
    if not model.langs:
        return docs.where(langid.has_letter(docs["text"]))
    return docs.where(langid.predict(docs["text"], model)["lang_pred"] != langid.UND)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near duplicates (five words, 0.8) the smallest doc_id.
    Rows that repeat a doc_id share its fate; rows without doc_id stay."""
    gone = near_dups.near_duplicates(docs).where("not kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct()
    return anti_join(docs, written(gone, "gone"), ["doc_id"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of ``benchmark``."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: SQL can't express language ID or packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
