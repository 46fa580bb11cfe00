"""Page snapshots: the fetched page is a row (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import spread


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages, spread over the cores because parsing them is the costly part."""
    return spread(spark.read.parquet(path))
