"""Continuous refresh of a collection from a folder of document files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.embed import BatchFunction
from gleaner.plans.refresh import refresh
from gleaner.schema import DOCUMENTS
from gleaner.session import ship_package, stored
from gleaner.sources import index

VERSIONED = T.StructType([*DOCUMENTS.fields, T.StructField("version", T.LongType())])
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Files of a batch that are named in the plan of its second read.
MAX_FILES = 1_000


def _told() -> tuple[Column, Column]:
    """What a document says as JSON, missing values included, and when its batch began, in microseconds."""
    document = F.to_json(F.struct(*[field.name for field in DOCUMENTS.fields]), {"ignoreNullFields": "false"})
    return document, F.unix_micros(F.current_timestamp())


def newer_versions(documents: DataFrame) -> DataFrame:
    """What a stream of documents (with ``version`` and ``path``, its file) tells that is newer than all before: doc_key, version, digest, path.

    Versions are ordered by number, equal numbers by what the document says, so that the last one to pass is the same in
    whatever order, and however often, they arrive. The state is one such row per key; of equal ones the first to arrive stays, and
    only what arrived with the batch passes. A row without a key is left out.
    """
    document, now = _told()
    told = F.struct("version", F.md5(document).alias("digest"), (-now).alias("before"), "path")
    newest = documents.where(F.col("doc_key").isNotNull()).select("doc_key", told.alias("told")).groupBy("doc_key").agg(F.max("told").alias("told"))
    return newest.where(F.col("told.before") == -now).select("doc_key", "told.version", "told.digest", "told.path")


def rows_of(accepted: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` (with ``version`` and ``path``) that ``accepted`` names; files without any are not read, if it names few."""
    files = [row["path"] for row in accepted.select("path").distinct().limit(MAX_FILES + 1).collect()]
    if len(files) <= MAX_FILES:
        documents = documents.where(F.col("path").isin(files))
    place = ["doc_key", "path", "version", "digest"]
    return documents.withColumn("digest", F.md5(_told()[0])).join(accepted, place, "left_semi").select(*DOCUMENTS.names)


def stream_refresh(
    spark: SparkSession,
    folder: str,
    root: str,
    name: str,
    factory: Callable[[], BatchFunction],
    model_name: str,
    checkpoint: str,
    options: index.Options = index.Options(),
    version: Column | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in every Parquet file of documents that appeared in ``folder`` since last time.

    Of a document the newest version counts, by the column ``version`` of the files, or by when its file appeared where that is
    missing. Versions may come late, repeatedly and in any order: those older than one taken in before are passed over, also by
    a stream that starts again from its checkpoint. A document without a text, or a blank one, is taken out. A batch that is
    repeated after a failure finds its chunks in place and changes nothing.
    """
    ship_package(spark)
    reader = spark.readStream.schema(VERSIONED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrived = F.unix_millis(F.col("_metadata.file_modification_time"))
    number = F.coalesce(F.col("version") if version is None else version, arrived)

    def own(files: DataFrame) -> DataFrame:
        return files.withColumns({"version": number, "path": F.col("_metadata.file_path")}).where(F.col("collection") == name)

    def take_in(batch: DataFrame, _: int) -> None:
        # Written out: the state is read once, and each further step would read it again.
        accepted = stored(batch, "accepted")
        files = accepted.sparkSession.read.schema(VERSIONED).parquet(folder)
        rows = stored(rows_of(accepted, own(files)), "documents")
        refresh(rows, root, name, factory, model_name, full_snapshot=False, options=options)

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return (
            newer_versions(own(reader.parquet(folder))).writeStream.outputMode("update").foreachBatch(take_in)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:  # a query keeps the settings it was started with
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
