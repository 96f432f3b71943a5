"""Streaming forms: continuous ingest, first-seen filtering and session expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, admit: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every micro-batch to ``admit(batch, number)``; ``once`` drains what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(admit)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_seen(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key did not occur within the watermark; the state is bounded by ``delay``."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, at: str, ttl: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per key that end after ``ttl`` without events."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, ttl).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n")


def windowed_counts(stream: DataFrame, at: str, kind: str, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per kind and window; rows later than the watermark are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("started"), kind, "n")
