"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.session import ship


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; columns are pruned by the plan that uses it."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")
