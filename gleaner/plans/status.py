"""Counts, health and query statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collection_counts(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks per collection of ``names`` (collection); 0 for one that does not exist.

    The counts are those the catalog keeps, taken while the chunks were written: no chunk is read.
    """
    return names.join(catalog.select("collection", "n_chunks"), "collection", "left").select(
        "collection", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )


def health(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks and model per collection; both NULL for a collection never built."""
    return names.join(catalog.select("collection", "n_chunks", "embed_model"), "collection", "left").select(
        "collection", "n_chunks", "embed_model")


def status_of(known: Column, n_chunks: Column, answered: Column) -> Column:
    """unknown, missing, empty, no_results or ok."""
    return (
        F.when(known.isNull(), "unknown")
        .when(n_chunks.isNull(), "missing")
        .when(n_chunks == 0, "empty")
        .when(~answered, "no_results")
        .otherwise("ok")
    )


def query_status(queries: DataFrame, hits: DataFrame, catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Why each query has the hits it has: unknown, missing, empty, no_results or ok."""
    known = health(catalog, names).select(
        F.col("collection").alias("known"), F.col("n_chunks")
    )
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    joined = queries.join(known, F.col("collection") == F.col("known"), "left").join(
        found, "query_id", "left"
    )
    n_hits = F.coalesce("n_hits", F.lit(0))
    return joined.select(
        "query_id", "collection",
        status_of(F.col("known"), F.col("n_chunks"), n_hits > 0).alias("status"),
        n_hits.alias("n_hits"),
    )


def coverage(statuses: DataFrame) -> DataFrame:
    """Queries per collection and status."""
    return statuses.groupBy("collection", "status").agg(F.count(F.lit(1)).alias("n_queries"))
