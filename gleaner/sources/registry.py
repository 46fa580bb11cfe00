"""The source registry: one JSON document with an array of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.schema import REGISTRY_ENTRY


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per registered source; none when the document has no ``sources``."""
    layout = T.StructType([T.StructField("sources", T.ArrayType(REGISTRY_ENTRY))])
    document = spark.read.schema(layout).option("multiLine", True).json(path)
    return document.select(F.inline("sources"))
