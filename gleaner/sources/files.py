"""File trees as tables: distributed listing and reading.

Spark's ``binaryFile`` source leaves out names that start with ``_`` or ``.`` (every
``__init__.py``), so listing and reading go through Arrow filesystems inside the tasks.
Paths may be local or any URI Arrow knows (s3://, hdfs://, gs://).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import relative_path
from gleaner.session import stored

# A batch of file contents is handed on when it reaches this size.
BATCH_BYTES = 32 << 20
BATCH_ENTRIES = 50_000
# Bytes of file contents one task reads.
TASK_BYTES = 128 << 20
_ENTRIES = "source string, root string, path string, is_dir boolean, size long"
_ENTRY_SCHEMA = pa.schema([
    ("source", pa.string()), ("root", pa.string()), ("path", pa.string()),
    ("is_dir", pa.bool_()), ("size", pa.int64()),
])


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if _SCHEME.match(path) else (fs.LocalFileSystem(), path)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.to_pylist():
            filesystem, place = _open(folder["path"])
            prefix = folder["path"].removesuffix(place)
            # A folder may go while its tree is listed; a root that is missing is an error.
            below = folder["path"].rstrip("/") != folder["root"].rstrip("/")
            entries = filesystem.get_file_info(fs.FileSelector(place, allow_not_found=below))
            if isinstance(filesystem, fs.LocalFileSystem):
                # A link to a folder is not followed: it may lead back up.
                entries = [e for e in entries if e.is_file or not os.path.islink(e.path)]
            for at in range(0, len(entries), BATCH_ENTRIES):
                part = entries[at:at + BATCH_ENTRIES]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(folder["source"], len(part)),
                        pa.repeat(folder["root"], len(part)),
                        pa.array([prefix + entry.path for entry in part]),
                        pa.array([entry.type == fs.FileType.Directory for entry in part]),
                        pa.array([entry.size for entry in part], pa.int64()),
                    ],
                    schema=_ENTRY_SCHEMA,
                )


def list_files(roots: DataFrame) -> DataFrame:
    """All files below the ``root`` of each ``source``: source, path, file_path, size.

    Works level by level, one row per folder, so a single large tree is shared out among
    the tasks. A missing root is an error.
    """
    tasks = roots.sparkSession.sparkContext.defaultParallelism
    folders = roots.select("source", "root", F.rtrim("root", F.lit("/")).alias("path"))
    levels: list[DataFrame] = []
    while True:
        entries = stored(folders.repartition(tasks).mapInArrow(_list, _ENTRIES), "entries")
        levels.append(entries.where("not is_dir"))
        folders = entries.where("is_dir").select("source", "root", "path")
        if folders.isEmpty():
            break
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.select(
        "source", "path", relative_path(F.col("path"), F.col("root")).alias("file_path"), "size"
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source", pa.string()), ("file_path", pa.string()), ("content", pa.binary())])
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for entry in batch.to_pylist():
            filesystem, place = _open(entry["path"])
            try:
                with filesystem.open_input_stream(place) as stream:
                    content = stream.read()
            except OSError:
                content = None
            rows.append({"source": entry["source"], "file_path": entry["file_path"], "content": content})
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_files(manifest: DataFrame, accepts: Column | None = None) -> DataFrame:
    """Contents of the manifest's files: source, file_path, content (NULL if unreadable).

    ``accepts`` is applied before any byte is read. The manifest is small beside the files,
    so it is shuffled to spread large folders over tasks, as many as the bytes ask for.
    """
    wanted = manifest if accepts is None else manifest.where(accepts)
    n_bytes = wanted.agg(F.sum("size")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, n_bytes // TASK_BYTES)
    entries = wanted.select("source", "path", "file_path")
    return entries.repartition(tasks).mapInArrow(_read, "source string, file_path string, content binary")


_PIECE_SCHEMA = pa.schema([
    ("source", pa.string()), ("file_path", pa.string()), ("start", pa.int64()), ("content", pa.binary()), ("error", pa.string()),
])


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for entry in batch.to_pylist():
            filesystem, place = _open(entry["path"])
            content, error = None, None
            try:
                with filesystem.open_input_file(place) as file:
                    file.seek(entry["start"])
                    content = file.read(entry["length"])
                if len(content) < entry["length"]:
                    content, error = None, "shorter than listed"
            except OSError as reason:
                error = str(reason) or type(reason).__name__
            rows.append({"source": entry["source"], "file_path": entry["file_path"], "start": entry["start"],
                         "content": content, "error": error})
            held += len(content or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ENTRIES:
                yield pa.RecordBatch.from_pylist(rows, schema=_PIECE_SCHEMA)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_PIECE_SCHEMA)


def read_pieces(manifest: DataFrame, accepts: Column | None = None, piece_bytes: int = BATCH_BYTES) -> DataFrame:
    """Contents of the manifest's files in pieces: source, file_path, start, content, error.

    A piece has ``piece_bytes`` at most, so that a file of any size is read by many tasks in bounded memory. Pieces cover a file
    as it was listed; an empty file has one empty piece. A piece that cannot be read, or that the file no longer has, is a
    row with its ``error`` and no content.
    """
    if piece_bytes < 1:
        raise ValueError("a piece has at least one byte")
    wanted = manifest if accepts is None else manifest.where(accepts)
    n_bytes = wanted.agg(F.sum("size")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, n_bytes // TASK_BYTES)
    size, step = F.coalesce("size", F.lit(0)).cast("long"), F.lit(piece_bytes).cast("long")
    pieces = wanted.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), step)))
    entries = pieces.select("source", "path", "file_path", "start", F.least(step, size - F.col("start")).alias("length"))
    return entries.repartition(tasks).mapInArrow(
        _read_pieces, "source string, file_path string, start long, content binary, error string")


def scan_files(roots: DataFrame, accepts: Column | None = None) -> DataFrame:
    """List and read the trees of ``roots`` (source, root)."""
    return read_files(list_files(roots), accepts)
