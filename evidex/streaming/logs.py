"""Rollups of append-only logs, the same in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", late: str = "2 hours") -> DataFrame:
    """(hour, kind, n, total): tumbling hours; events later than ``late`` are dropped from a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    rolled = rows.groupBy(F.window(ts, "1 hour").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).alias("total"))
    return rolled.select(F.col("w.start").alias("hour"), "kind", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def write_hourly(events: DataFrame, path: str, checkpoint: str):
    """Appends finished hours to a folder, exactly once, and stops when what is there is read."""
    return hourly(events).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
