"""The chunk index: versioned collections in Parquet below one root.

``chunks/segment=<id>/collection=<name>/bucket=<n>``    chunks and vectors that one commit added
``removed/segment=<id>/collection=<name>``              document keys that a commit took out of older segments
``versions/collection=<name>/version=<n>``              one row that tells what a version consists of

A commit writes its segment first and its version row, a single file, last. Readers take the newest version that has its row, so a job
that dies on the way leaves what was there, and nobody sees half a commit. A version also tells an empty
collection from one never built, and carries the counts, the embedding model and the chunk options of the collection.
A document is live in the newest segment that has it, unless a later commit removed its key. ``compact`` merges
the segments of a collection, ``vacuum`` deletes files that no kept version needs.

``bucket`` is a hash of the document key.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.schema import CHUNK_OVERLAP, CHUNK_TOKENS, CHUNKS
from gleaner.session import stored

DEFAULT_BUCKETS = 16
# Removed keys of about 130 bytes each that are broadcast: at most about 64 MB.
BROADCAST_KEYS = 500_000
SEGMENT = T.StructField("segment", T.StringType())
INDEXED = T.StructType([*CHUNKS.fields, SEGMENT])
_REMOVED = T.StructType([T.StructField(name, T.StringType()) for name in ("doc_key", "segment", "collection")])


@dataclass(frozen=True)
class Options:
    """How the documents of a collection become vectors; kept with the collection."""

    chunking: str = "window"
    size: int = CHUNK_TOKENS
    overlap: int = CHUNK_OVERLAP
    with_metadata: bool = False


@dataclass(frozen=True)
class Version:
    """One version of a collection."""

    name: str
    number: int
    embed_model: str
    fingerprint: str | None  # of the model's weights, if it has any
    n_buckets: int
    options: Options = Options()
    segments: tuple[str, ...] = ()
    removed: tuple[str, ...] = ()
    layout: str | None = None  # vectors by cell, see plans.layout
    covered: tuple[str, ...] = ()  # segments that the layout holds
    n_chunks: int = 0
    n_documents: int = 0


_VERSION = T.StructType([
    T.StructField("embed_model", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("n_buckets", T.IntegerType()), T.StructField("chunking", T.StringType()),
    T.StructField("size", T.IntegerType()), T.StructField("overlap", T.IntegerType()),
    T.StructField("with_metadata", T.BooleanType()),
    T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType())),
    T.StructField("layout", T.StringType()), T.StructField("covered", T.ArrayType(T.StringType())),
    T.StructField("n_chunks", T.LongType()), T.StructField("n_documents", T.LongType()),
])
_CATALOG = "collection string, embed_model string, n_buckets int, n_chunks long, n_documents long"


def chunks_path(root: str) -> str:
    return f"{root.rstrip('/')}/chunks"


def removed_path(root: str) -> str:
    return f"{root.rstrip('/')}/removed"


def versions_path(root: str) -> str:
    return f"{root.rstrip('/')}/versions"


# Versions.


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whatever filesystem holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(status.getPath()) for status in found or []]


def _numbers(paths: Iterable[str]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for path in paths:
        place = re.search(r"/collection=([^/]+)/version=(\d+)", path)
        if place:
            found.setdefault(place[1], []).append(int(place[2]))
    return found


def _version(name: str, number: int, row) -> Version:
    return Version(
        name, number, row["embed_model"], row["fingerprint"], row["n_buckets"],
        Options(row["chunking"], row["size"], row["overlap"], row["with_metadata"]), tuple(row["segments"]), tuple(row["removed"]),
        row["layout"], tuple(row["covered"]), row["n_chunks"], row["n_documents"])


def versions(spark: SparkSession, root: str) -> dict[str, Version]:
    """The current version of every collection; a version without its row was never finished."""
    finished = _numbers(glob(spark, f"{versions_path(root)}/collection=*/version=*/part-*"))
    if not finished:
        return {}
    paths = [f"{versions_path(root)}/collection={name}/version={max(numbers)}" for name, numbers in finished.items()]
    layout = T.StructType([*_VERSION.fields, T.StructField("collection", T.StringType()), T.StructField("version", T.LongType())])
    # One row per collection.
    rows = spark.read.schema(layout).option("basePath", versions_path(root)).parquet(*paths).collect()
    return {row["collection"]: _version(row["collection"], row["version"], row) for row in rows}


def next_number(spark: SparkSession, root: str, names: Sequence[str]) -> int:
    """A number above those of all versions of the named collections, finished or not."""
    begun = _numbers(glob(spark, f"{versions_path(root)}/collection=*/version=*"))
    return 1 + max((number for name in names for number in begun.get(name, [])), default=0)


def new_segment(number: int) -> str:
    """A folder name of its own, in the order of the commits."""
    return f"{number:010d}-{uuid.uuid4().hex[:8]}"


def commit(spark: SparkSession, root: str, old: Version | None, new: Version) -> None:
    """Make ``new`` the current version, if ``old`` still is: the last step of every change."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", new.name):
        raise ValueError(f"collection name {new.name!r} cannot be a folder name")
    finished = _numbers(glob(spark, f"{versions_path(root)}/collection={new.name}/version=*/part-*")).get(new.name, [])
    if max(finished, default=None) != (old.number if old else None):
        raise RuntimeError(f"collection {new.name!r} was changed by another job meanwhile")
    o = new.options
    row = (new.embed_model, new.fingerprint, new.n_buckets, o.chunking, o.size, o.overlap, o.with_metadata, list(new.segments),
           list(new.removed), new.layout, list(new.covered), new.n_chunks, new.n_documents)
    spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("error").parquet(
        f"{versions_path(root)}/collection={new.name}/version={new.number}")


# Reading.


def _removed(spark: SparkSession, root: str, current: Iterable[Version]) -> DataFrame | None:
    """Keys with the newest segment that removed them; None if nothing was ever removed."""
    paths = [f"{removed_path(root)}/segment={segment}/collection={version.name}" for version in current for segment in version.removed]
    if not paths:
        return None
    rows = spark.read.schema(_REMOVED).option("basePath", removed_path(root)).parquet(*paths)
    return rows.groupBy(F.col("collection").alias("gone_from"), F.col("doc_key").alias("gone_key")).agg(
        F.max("segment").alias("gone_at"))


def without_removed(spark: SparkSession, root: str, current: Iterable[Version], rows: DataFrame) -> DataFrame:
    """Rows (collection, doc_key, segment, ...) whose key no later commit removed.

    Up to ``BROADCAST_KEYS`` keys are broadcast, whatever size Spark guesses for them, and rows with their vectors are not shuffled.
    """
    gone = _removed(spark, root, current)
    if gone is None:
        return rows
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    later = (F.col("collection") == F.col("gone_from")) & (F.col("doc_key") == F.col("gone_key")) & (F.col("segment") < F.col("gone_at"))
    return rows.join(gone, later, "left_anti")


def live(
    spark: SparkSession, root: str, current: Sequence[Version], beside_layout: bool = False, told: Sequence[Column] = (),
) -> DataFrame:
    """Live chunks of the given versions; only their files are listed. ``beside_layout`` leaves out what a layout holds.

    With ``told`` these columns take the place of texts and vectors, before rows are compared with removed keys.
    """
    paths = [f"{chunks_path(root)}/segment={segment}/collection={version.name}"
             for version in current for segment in version.segments if not (beside_layout and segment in version.covered)]
    if not paths:
        none = spark.createDataFrame([], INDEXED)
        return none.select("*", *told).drop("text", "embedding") if told else none
    chunks = spark.read.schema(INDEXED).option("basePath", chunks_path(root)).parquet(*paths)
    if told:
        chunks = chunks.select("*", *told).drop("text", "embedding")
    return without_removed(spark, root, current, chunks)


def ensure_index(spark: SparkSession, root: str, told: Sequence[Column] = ()) -> DataFrame:
    """All live chunks of the index; an empty table when nothing was ever written."""
    return live(spark, root, list(versions(spark, root).values()), told=told)


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Live chunks of one collection; other collections' files are not read."""
    current = versions(spark, root).get(name)
    return live(spark, root, [current] if current else []).where(F.col("collection") == name)


def catalog_rows(spark: SparkSession, current: Iterable[Version]) -> DataFrame:
    return spark.createDataFrame([(v.name, v.embed_model, v.n_buckets, v.n_chunks, v.n_documents) for v in current], _CATALOG)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """The created collections: collection, embed_model, n_buckets, n_chunks, n_documents. Reads no chunk file."""
    return catalog_rows(spark, versions(spark, root).values())


def bucket_of(doc_key: Column, n_buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(doc_key), n_buckets).cast("int")


def n_buckets_of(spark: SparkSession, root: str, name: str) -> int | None:
    """Number of buckets of a collection, None when it does not exist."""
    current = versions(spark, root).get(name)
    return None if current is None else current.n_buckets


def check_model(version: Version, embed_model: str, fingerprint: str | None) -> None:
    """Refuse vectors of another model: of another name, or of the same name and other weights."""
    if version.embed_model != embed_model:
        raise ValueError(f"collection {version.name!r} holds vectors of {version.embed_model!r}, not of {embed_model!r}")
    if fingerprint and version.fingerprint and fingerprint != version.fingerprint:
        raise ValueError(f"collection {version.name!r} holds vectors of {embed_model!r} with other weights")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the index on whatever filesystem holds it."""
    hadoop_path: JavaObject = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


# Writing.


def gather(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Bring the rows of a bucket together, AQE splitting the over-full ones.

    Done on documents, before they are chunked and embedded, it moves the least data; and
    every task then writes few, large files.
    """
    bucket = bucket_of(F.col("doc_key"), n_buckets)
    return rows.withColumn("bucket", bucket).hint("rebalance", "collection", "bucket")


def _conform(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """Columns in index order."""
    present = set(chunks.columns)
    return chunks.withColumn("bucket", bucket_of(F.col("doc_key"), n_buckets)).select(*[
        (F.col(f.name) if f.name in present | {"bucket"} else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CHUNKS.fields
    ])


def write_segment(chunks: DataFrame, root: str, names: Sequence[str], segment: str, n_buckets: int) -> dict[str, tuple[int, int]]:
    """Write the chunks of the named collections as a segment, in one job; chunks and documents of each, counted as they are written."""
    observed = Observation()
    own = F.col("collection")
    counts = [column for at, name in enumerate(names) for column in (
        F.count_if(own == name).alias(f"chunks_{at}"), F.count_if((own == name) & (F.col("chunk_no") == 0)).alias(f"documents_{at}"))]
    rows = _conform(chunks.where(own.isin(*names)), n_buckets).observe(observed, *counts)
    rows.write.partitionBy("collection", "bucket").parquet(f"{chunks_path(root)}/segment={segment}")
    return {name: (observed.get[f"chunks_{at}"], observed.get[f"documents_{at}"]) for at, name in enumerate(names)}


def _opened(
    spark: SparkSession, root: str, names: Sequence[str], embed_model: str, fingerprint: str | None, n_buckets: int, options: Options,
) -> tuple[dict[str, Version], int]:
    """Versions of the named collections, new ones unnumbered, and their one number of buckets."""
    current = versions(spark, root)
    found = {name: current.get(name) or Version(name, 0, embed_model, fingerprint, n_buckets, options) for name in names}
    for version in found.values():
        check_model(version, embed_model, fingerprint)
    sizes = {version.n_buckets for version in found.values()}
    if len(sizes) > 1:
        raise ValueError(f"collections {list(names)} have different numbers of buckets")
    return found, sizes.pop()


def _old(version: Version) -> Version | None:
    return version if version.number else None


def append(
    chunks: DataFrame, root: str, names: Sequence[str], embed_model: str, n_buckets: int = DEFAULT_BUCKETS,
    fingerprint: str | None = None, options: Options = Options(), made: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> dict[str, tuple[int, int]]:
    """Add the chunks of documents that the named collections lack, creating these on first use; chunks and documents added.

    A document that is present stays as it is, so that an append may be repeated; a changed one
    takes a refresh. ``chunks`` may be documents, of which ``made`` makes chunks: known documents are dropped before, so that
    none is chunked and embedded in vain, and no vectors meet the keys, however many these are.
    """
    spark = chunks.sparkSession
    opened, n_buckets = _opened(spark, root, names, embed_model, fingerprint, n_buckets, options)
    built = [v for v in opened.values() if v.number]
    lacking = chunks
    if built:
        present = live(spark, root, built).where("chunk_no = 0").select("collection", "doc_key")
        lacking = chunks.join(stored(present, "present"), ["collection", "doc_key"], "left_anti")
    lacking = made(lacking)
    number = next_number(spark, root, names)
    segment = new_segment(number)
    counts = write_segment(lacking, root, names, segment, n_buckets)
    for name, version in opened.items():
        n_chunks, n_documents = counts[name]
        if n_chunks or not version.number:
            commit(spark, root, _old(version), replace(
                version, number=number, segments=(*version.segments, *([segment] if n_chunks else [])),
                n_chunks=version.n_chunks + n_chunks, n_documents=version.n_documents + n_documents))
    return counts


def rebuild(
    chunks: DataFrame, root: str, names: Sequence[str], embed_model: str, n_buckets: int = DEFAULT_BUCKETS,
    fingerprint: str | None = None, options: Options = Options(),
) -> dict[str, tuple[int, int]]:
    """Fill the named collections anew; the others stay. Chunks and documents written.

    What a collection held is seen until all of its new chunks are written. One that gets no chunks exists and is empty.
    """
    spark = chunks.sparkSession
    current = versions(spark, root)
    number = next_number(spark, root, names)
    segment = new_segment(number)
    counts = write_segment(chunks, root, names, segment, n_buckets)
    for name in names:
        n_chunks, n_documents = counts[name]
        commit(spark, root, current.get(name), Version(
            name, number, embed_model, fingerprint, n_buckets, options, (segment,) if n_chunks else (),
            n_chunks=n_chunks, n_documents=n_documents))
    return counts


def write_index(
    chunks: DataFrame, root: str, names: Sequence[str], embed_model: str, mode: str = "append", n_buckets: int = DEFAULT_BUCKETS,
    fingerprint: str | None = None, options: Options = Options(),
) -> dict[str, tuple[int, int]]:
    return {"append": append, "rebuild": rebuild}[mode](chunks, root, names, embed_model, n_buckets, fingerprint, options)


def replace_documents(old: Version, gone: DataFrame, fresh: DataFrame, root: str) -> Version:
    """A commit that takes the documents ``gone`` (doc_key) out of a collection and adds the chunks ``fresh``; the new version.

    Only the fresh chunks and the keys that go are written. ``old`` may be a version that was never committed.
    """
    spark = gone.sparkSession
    number = next_number(spark, root, [old.name])
    segment = new_segment(number)
    n_chunks, n_documents = write_segment(fresh, root, [old.name], segment, old.n_buckets)[old.name]
    gone = stored(gone.select("doc_key").distinct(), "gone")
    n_gone = gone.count()
    n_dead = 0
    if n_gone:
        gone.withColumn("collection", F.lit(old.name)).write.partitionBy("collection").parquet(f"{removed_path(root)}/segment={segment}")
        n_dead = live(spark, root, [old]).select("doc_key").join(gone, "doc_key", "left_semi").count()
    new = replace(
        old, number=number, segments=(*old.segments, *([segment] if n_chunks else [])),
        removed=(*old.removed, *([segment] if n_gone else [])),
        n_chunks=old.n_chunks + n_chunks - n_dead, n_documents=old.n_documents + n_documents - n_gone)
    commit(spark, root, _old(old), new)
    return new


def compact(spark: SparkSession, root: str, name: str) -> Version:
    """Merge the segments of a collection into one without removed documents; the new version, which has no layout.

    Searches before and after give the same hits. Files of older versions stay for their readers until a ``vacuum``.
    """
    old = versions(spark, root)[name]
    number = next_number(spark, root, [name])
    segment = new_segment(number)
    rows = live(spark, root, [old]).hint("rebalance", "collection", "bucket")
    n_chunks, n_documents = write_segment(rows, root, [name], segment, old.n_buckets)[name]
    new = replace(old, number=number, segments=(segment,) if n_chunks else (), removed=(), layout=None, covered=(),
                  n_chunks=n_chunks, n_documents=n_documents)
    commit(spark, root, old, new)
    return new


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete what no current version needs: older versions, their segments, unfinished commits; the folders deleted.

    Not to be run beside a job that writes to the index, or a reader of an older version.
    """
    current = versions(spark, root)
    kept = {f"collection={v.name}/version={v.number}" for v in current.values()}
    gone = [path for path in glob(spark, f"{versions_path(root)}/collection=*/version=*") if "/".join(path.split("/")[-2:]) not in kept]
    folders = {"chunks": "segments", "removed": "removed"}
    for folder, part in folders.items():
        needed = {f"segment={segment}/collection={v.name}" for v in current.values() for segment in getattr(v, part)}
        gone += [path for path in glob(spark, f"{root.rstrip('/')}/{folder}/segment=*/collection=*")
                 if "/".join(path.split("/")[-2:]) not in needed]
    layouts = {f"layout={v.layout}" for v in current.values() if v.layout}
    gone += glob(spark, f"{root.rstrip('/')}/reembedded/segment=*")
    for folder in ("cells", "centres"):
        gone += [path for path in glob(spark, f"{root.rstrip('/')}/{folder}/layout=*") if path.split("/")[-1] not in layouts]
    for path in gone:
        drop_path(spark, path)
    return gone
