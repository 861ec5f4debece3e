"""Structured Streaming into a store: statements as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rdf import LINE


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of quads from N-Triples or N-Quads files that arrive in a folder; bad lines are left out."""
    lines = spark.readStream.text(folder)
    part = lambda k: F.regexp_extract("value", LINE, k)
    return lines.where(part(1) != "").select(F.when(part(4) != "", part(4)).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def into_store(quads: DataFrame, store, checkpoint: str, remove: bool = False, available_now: bool = True):
    """Applies each micro-batch to the store as one version. A batch that is run again
    after a failure changes nothing, since a store holds a set."""

    def apply(batch: DataFrame, _number: int) -> None:
        store.change(**{"removes" if remove else "adds": batch})

    writer = quads.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay(log: DataFrame, store, checkpoint: str):
    """Applies a stream of logged updates (text, seq) in order of seq within each batch."""

    def apply(batch: DataFrame, _number: int) -> None:
        for row in batch.orderBy("seq").toLocalIterator():
            store.update(row["text"])

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predicate_counts(quads: DataFrame, event_time: str, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Statements by predicate and event-time window, with a watermark for late ones."""
    return quads.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "p").agg(F.count("*").alias("n"))
