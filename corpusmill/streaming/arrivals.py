"""Incremental forms for arriving rows. The batch operators have no streams; these are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.chunking import chunk


def new_chunks(docs: DataFrame, strategy: str, event_time: str, late: str = "1 hour") -> DataFrame:
    """Chunks of an unbounded documents stream, each uid once within the watermark."""
    found = chunk(docs, [strategy], keep=(event_time,))
    return found.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["chunk_uid"])


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are dropped."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
        .select(F.col("window.start").alias("start"), key, "n", "total")
    )
