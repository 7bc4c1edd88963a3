"""Pages as a stream: the batch plan's columns on files that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import site


def stream_pages(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Documents of pages(url, html, fetched_at) that arrive as Parquet files, each URL once within ``delay``."""
    pages = spark.readStream.schema("url string, html string, fetched_at timestamp").parquet(folder)
    return site.documents(pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"]))
