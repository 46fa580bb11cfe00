"""Change of the embedding model of a collection, bucket by bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.embed import BatchFunction
from gleaner.plans.build import embed_chunks, model_fingerprint
from gleaner.schema import CHUNKS
from gleaner.sources import index

BUCKETS_PER_JOB = 4
_DONE = "bucket int, n_chunks long, n_documents long"


def progress_path(root: str, segment: str) -> str:
    return f"{root.rstrip('/')}/reembedded/segment={segment}"


def finished(spark: SparkSession, root: str, segment: str) -> dict[int, tuple[int, int]]:
    """Chunks and documents of the buckets that are done; a row per bucket."""
    paths = index.glob(spark, f"{progress_path(root, segment)}/part=*/part-*")
    rows = spark.read.schema(_DONE).parquet(*paths).collect() if paths else []
    return {row["bucket"]: (row["n_chunks"], row["n_documents"]) for row in rows}


def reembed(
    spark: SparkSession, root: str, name: str, factory: Callable[[], BatchFunction], model_name: str, buckets_per_job: int = BUCKETS_PER_JOB,
) -> index.Version:
    """Give all live chunks of a collection vectors of another model, in one commit; the new version.

    Texts and chunks stay as they are. Buckets are written a few at a time to a segment of their own, named after the version and
    the model, and noted down when they are there: a job that was interrupted goes on with the buckets that are missing. Until the commit
    searches find the old vectors, by the old model; a change of the collection meanwhile makes the commit fail, and the
    job starts anew. The new version has no layout.
    """
    old = index.versions(spark, root)[name]
    fingerprint = model_fingerprint(factory)
    wanted = hashlib.sha256(f"{name}|{old.number}|{model_name}|{fingerprint}".encode()).hexdigest()
    segment = f"{old.number + 1:010d}-{wanted[:8]}"
    done = finished(spark, root, segment)
    left = [bucket for bucket in range(old.n_buckets) if bucket not in done]
    rows = index.live(spark, root, [old]).drop("segment")
    for at in range(0, len(left), buckets_per_job):
        buckets = left[at:at + buckets_per_job]
        _write(rows.where(F.col("bucket").isin(buckets)), root, segment, factory, model_name, old.options.with_metadata)
        written = spark.read.schema(index.INDEXED).option("basePath", index.chunks_path(root)).parquet(
            f"{index.chunks_path(root)}/segment={segment}").where(F.col("bucket").isin(buckets))
        counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("chunk_no") == 0).alias("n_documents"))
        told = spark.createDataFrame([(bucket,) for bucket in buckets], "bucket int").join(counts, "bucket", "left").na.fill(0)
        told.select("bucket", "n_chunks", "n_documents").coalesce(1).write.mode("overwrite").parquet(
            f"{progress_path(root, segment)}/part={buckets[0]}")
    done = finished(spark, root, segment)
    n_chunks, n_documents = (sum(counts[at] for counts in done.values()) for at in range(2))
    new = replace(
        old, number=index.next_number(spark, root, [name]), embed_model=model_name, fingerprint=fingerprint,
        segments=(segment,) if n_chunks else (), removed=(), layout=None, covered=(), n_chunks=n_chunks, n_documents=n_documents)
    index.commit(spark, root, old, new)
    return new


def _write(rows: DataFrame, root: str, segment: str, factory: Callable[[], BatchFunction], model_name: str, with_metadata: bool) -> None:
    """Write buckets of a segment, over what an interrupted job left of them."""
    gathered = rows.drop("embedding", "embed_model").hint("rebalance", "collection", "bucket")  # texts move, vectors stay where they are made
    embed_chunks(gathered, factory, model_name, with_metadata).select(*CHUNKS.names).write.partitionBy("collection", "bucket").mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{index.chunks_path(root)}/segment={segment}")
