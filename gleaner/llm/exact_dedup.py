"""Exact dedup: stateful streaming deduplication with disk-backed state and a check of full texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from gleaner.llm.common import SPACE, text_of
from gleaner.session import scratch_path, stored

# The state lives in RocksDB; its files are not preallocated (4 MB each), as there may be many small ones. The stores of an
# executor share one bounded amount of memory outside the heap, whatever their number.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
SMALL_HITS = 1_000_000  # digests of 64 characters: at most about 100 MB


def normalised(text: Column) -> Column:
    """The text without white space; an empty text for a missing one."""
    return F.translate(text_of(text), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(documents: DataFrame, digest: Callable[[Column], Column] = sha256, locator: Column | None = None) -> DataFrame:
    """(doc_id, digest, n_points, locator) of every row, batch or stream; the text stays where it is."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(normalised(F.col("text"))).alias("digest"),
        F.length(text_of(F.col("text"))).cast("long").alias("n_points"),
        (F.lit(None).cast("string") if locator is None else locator).alias("locator"))


def _best() -> Column:
    """What a class retains: most code points, then smallest id (a missing id last), and where its content is."""
    return F.max(F.struct(
        F.col("n_points"), (-F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("minus_id"),
        F.col("doc_id").alias("keep_id"), F.col("locator"))).alias("best")


def fold_stream(keys: DataFrame, spark: SparkSession) -> DataFrame:
    """Run the stream of :func:`keyed` rows to its end; returns (digest, group_size, best).

    The state is keyed by digest and never expires. It lives in RocksDB, on the executors' disks, with its changes in the
    shared folder, so that a lost executor's state is loaded again. Copies are combined in each task before they are
    sent, so that a group of any size sends a row per task. Each batch writes the classes it changed; the last state of each
    digest counts.
    """
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    out, log = scratch_path(spark, "classes"), scratch_path(spark, "dedup-log")
    try:
        classes = keys.groupBy("digest").agg(_best(), F.count("*").alias("group_size"))

        def write(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        classes.writeStream.outputMode("update").option("checkpointLocation", log).trigger(
            availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    schema = classes.schema
    try:
        states = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    except Exception as error:  # a stream without any file starts no batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    # The state only grows, so that the largest count of a digest is its last.
    return states.groupBy("digest").agg(
        F.max(F.struct("group_size", "best")).alias("last")).select("digest", "last.group_size", "last.best")


def check_hits(documents: DataFrame, classes: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Distinct texts of the digests that were hit: (digest, content, group_size, best), one row per full text.

    Texts are compared whole: they are grouped by all their characters, combined in each task before the
    shuffle. The digests go to the scan as a broadcast if there are few, else the texts go to the digests.
    """
    hits = stored(classes.filter("group_size > 1").select("digest"), "hits")
    if hits.count() <= SMALL_HITS:
        hits = F.broadcast(hits)
    wanted = documents.withColumns({
        "content": normalised(F.col("text")), "digest": digest(normalised(F.col("text"))),
        "n_points": F.length(text_of(F.col("text"))).cast("long"), "locator": F.lit(None).cast("string"),
        "doc_id": F.col("doc_id").cast("long")}).select(
        "digest", "content", "n_points", "doc_id", "locator").join(hits, "digest", "left_semi")
    return wanted.groupBy("digest", "content").agg(
        F.count("*").alias("group_size"), F.max(F.struct(
            F.col("n_points"), (-F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("minus_id"))).alias("best"))


def deduplicate(
    documents: DataFrame, stream: DataFrame, digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: doc_id, digest, n_points, keep_id, group_size, kept.

    ``stream`` holds the :func:`keyed` rows of the same documents. Texts are equal if they are without white space; a
    missing text counts as empty. Of equal texts the row with the most code points, then the smallest id stays, a
    missing id last. Rows that repeat both id and text are one document told twice: each row is returned, each
    is marked as kept. Digests that stand for several texts are split by the texts themselves.
    """
    spark = documents.sparkSession
    classes = stored(fold_stream(stream, spark), "classes")
    checked = stored(check_hits(documents, classes, digest).select(
        "digest", "group_size", (-F.col("best.minus_id")).alias("keep_id"),
        F.col("best.n_points").alias("most"), F.sha2(F.col("content").cast("binary"), 512).alias("content_id")), "checked")
    collided = stored(checked.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"),
                      "collided")
    keys = keyed(documents, digest)
    plain = classes.select(
        "digest", "group_size", F.col("best.keep_id").alias("keep_id"), F.col("best.n_points").alias("most"))
    if collided.isEmpty():
        return _told(keys, plain, ["digest"])
    content = documents.withColumn("content_id", F.sha2(normalised(F.col("text")).cast("binary"), 512))
    finer = keyed(content.withColumn("locator_", F.col("content_id")), digest, F.col("content_id")).withColumnRenamed(
        "locator", "content_id")
    split = _told(finer.join(collided, "digest", "left_semi"),
                  checked.join(collided, "digest", "left_semi"), ["digest", "content_id"])
    return _told(keys.join(collided, "digest", "left_anti"), plain, ["digest"]).unionByName(split)


def _told(keys: DataFrame, classes: DataFrame, on: list[str]) -> DataFrame:
    missing = F.lit(2**63 - 1)
    return keys.join(classes, on).select(
        "doc_id", "digest", "n_points", F.when(F.col("keep_id") == missing, None).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size", ((F.coalesce(F.col("doc_id"), missing) == F.coalesce(F.col("keep_id"), missing))
                       & (F.col("n_points") == F.col("most"))).alias("kept"))


def table_stream(spark: SparkSession, path: str, like: DataFrame, files: int | None = None) -> DataFrame:
    """The Parquet file or folder at ``path`` as a stream, ``files`` files per batch, with where each row lies."""
    reader: DataStreamReader = spark.readStream.schema(like.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, which may name a file


def where() -> Column:
    """Locator of a row's content: its file and its place there."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
