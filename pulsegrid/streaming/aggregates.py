"""Mergeable aggregates and sessions over streams of points and events.

The same functions serve batches: they use only what both have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell


def grid(points: DataFrame, size: float) -> DataFrame:
    """Count, sum, lowest and highest by cell; state grows with the cells, not the points."""
    keyed = points.withColumns({"row": cell("y", size), "col": cell("x", size)})
    return keyed.groupBy("row", "col").agg(F.count("*").alias("n"), F.sum("z").alias("sum"), F.min("z").alias("low"), F.max("z").alias("high"))


def voxel_counts(points: DataFrame, size: float) -> DataFrame:
    keyed = points.withColumns({f"i{c}": cell(c, size) for c in "xyz"})
    return keyed.groupBy("ix", "iy", "iz").agg(F.count("*").alias("hits"))


def pulse_sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key's events that stand no more than ``gap`` apart; events later than ``late`` are dropped."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    out = held.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windowed(events: DataFrame, width: str, slide: str | None, late: str) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    out = held.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Run a streaming query over what there is and stop; for tests and backfills in memory."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
