"""Structured Streaming forms of the refresh job and of event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import last_wins, upsert


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; state for windows older than the watermark is dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def continuous_upsert(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's last row per key replaces the stored one. ``write`` gets the batch number, so it can be idempotent."""

    def apply(batch: DataFrame, number: int) -> None:
        write(upsert(read(), last_wins(batch, [key], [order]), key), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
