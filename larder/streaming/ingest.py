"""Ingestion of recipe pages as they arrive: pages -> records -> a table that keeps the latest record of each recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions.text import canonical_url
from larder.operators.corpus import newest
from larder.sources import html


def page_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Pages ``(url string, html string, retrieved_at timestamp)`` of JSON-lines files appearing in a folder."""
    return spark.readStream.schema("url string, html string, retrieved_at timestamp").option("maxFilesPerTrigger", per_trigger).json(folder)


def records(pages: DataFrame) -> DataFrame:
    """Recipe records of a batch of pages with ``retrieved_at``, the latest page of each canonical URL."""
    last = newest(pages.select(canonical_url(F.col("url")).alias("url"), "html", "retrieved_at"), ["url"], [F.col("retrieved_at")])
    return html.recipes_of(last).join(last.select("url", "retrieved_at"), "url")


def ingest(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's records to ``target`` as a run; a repeated batch overwrites its own run only."""

    def write(batch: DataFrame, number: int) -> None:
        records(batch).write.mode("overwrite").parquet(f"{target}/run_id={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The most recently retrieved record of each recipe, whatever batch it came in (ties: the later batch)."""
    rows = spark.read.parquet(target)
    return newest(rows, ["site_recipe_id"], [F.col("retrieved_at"), F.col("run_id")])
