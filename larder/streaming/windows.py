"""Event-time windows, alike for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and summed value per hour and type; a stream forgets an hour ``late`` after it was last seen."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
