"""Event logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT = "timestamp string, event string, recipe_id string, issues array<string>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows; a line that is not JSON has null fields."""
    return spark.read.schema(EVENT).json(path)


def write_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
