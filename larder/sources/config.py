"""Category configuration: a JSON file with a list of categories (key, name, url, enabled)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY = "array<struct<key: string, name: string, url: string, enabled: boolean>>"


def read_categories(spark: SparkSession, path: str, field: str = "categories") -> DataFrame:
    """The enabled categories of a file that is such a list, or an object with one in ``field``."""
    whole = spark.read.text(path, wholetext=True)
    # An object would be read as a list of one, so the first sign decides.
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", CATEGORY)).otherwise(F.from_json("value", f"struct<{field}: {CATEGORY}>")[field])
    return whole.select(F.inline(listed)).where(F.coalesce("enabled", F.lit(True))).drop("enabled")
