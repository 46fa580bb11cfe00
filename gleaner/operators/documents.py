"""Files, pages and registries to the one wide documents table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import (
    content_hash, decode_utf8, is_blank, language_tag, source_key, strip, suffix,
)
from gleaner.operators import filters
from gleaner.operators.filters import long_enough
from gleaner.schema import DEFAULT_PRIORITY, DOCUMENTS

# Registry entries, of some names and numbers each, that are broadcast.
MAX_BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class FileProfile:
    """How one collection reads the shared files table."""

    collection: str
    accepts: Callable[[Column], Column]
    metadata: Callable[[Column], dict[str, Column]]
    stripped: bool = False


def _test_type(path: Column) -> Column:
    return F.when(suffix(path) == ".py", F.lit("python_test")).otherwise(F.lit("openfoam_config"))


PROFILES = {
    profile.collection: profile
    for profile in (
        FileProfile("code", filters.is_code_file, lambda path: {
            "repo": F.col("source"), "branch": F.col("branch"), "language": language_tag(path),
        }),
        FileProfile("docs", filters.is_doc_file, lambda path: {
            "source": F.col("source"), "format": language_tag(path),
        }, stripped=True),
        FileProfile("tests", filters.is_test_file, lambda path: {
            "repo": F.col("source"), "branch": F.col("branch"), "doc_type": _test_type(path),
            "language": language_tag(path, fallback="openfoam"),
        }),
        FileProfile("tutorials", filters.is_tutorial_file, lambda path: {
            "repo": F.col("source"), "category": F.col("category"),
            "priority": F.col("priority"), "source": F.lit("repo_sources"),
        }, stripped=True),
    )
}


def preferred_branch(branches: DataFrame) -> DataFrame:
    """One branch per source: main, else master, else the active one.

    ``branches`` has source, branch, active; the result has source, branch.
    """
    rank = (
        F.when(F.col("branch") == "main", 0)
        .when(F.col("branch") == "master", 1)
        .when(F.col("active"), 2)
    )
    return (
        branches.where(rank.isNotNull())
        .groupBy("source")
        .agg(F.min(F.struct(rank.alias("rank"), "branch")).alias("best"))
        .select("source", F.col("best.branch").alias("branch"))
    )


def registry_defaults(registry: DataFrame) -> DataFrame:
    """Registry entries with branch, category and priority filled in, and a path key."""
    return registry.select(
        "name", "url",
        F.coalesce("branch", F.lit("main")).alias("branch"),
        F.coalesce("category", F.lit("tutorials")).alias("category"),
        F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"),
        source_key(F.col("name")).alias("source_key"),
    )


def with_registry(files: DataFrame, selected: DataFrame, keep_others: bool = False) -> DataFrame:
    """Attach category and priority to the files of the selected sources.

    Files of other sources are dropped unless ``keep_others``. ``files`` may be a manifest:
    joined before its files are read, no content is read for nothing. The registry is
    broadcast once its size is known; contents are not shuffled.
    """
    entries = registry_defaults(selected).select(
        F.col("name").alias("source"), "category", "priority"
    )
    few = entries.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    return files.join(F.broadcast(entries) if few else entries, "source", "left" if keep_others else "inner")


def _outcome(accepted: Column) -> Column:
    return (
        F.when(~accepted, "type")
        .when(F.col("text").isNull(), "unreadable")
        .when(F.col("blank"), "blank")
        .otherwise("loaded")
    )


def _decoded(files: DataFrame, collections: tuple[str, ...]) -> DataFrame:
    """Decode what at least one collection accepts, once for all of them."""
    path = F.col("file_path")
    accepted = reduce(Column.__or__, [PROFILES[name].accepts(path) for name in collections])
    text = files.withColumn("text", F.when(accepted, decode_utf8(F.col("content")))).drop("content")
    return text.withColumn("blank", is_blank(F.col("text")))


def file_outcomes(files: DataFrame, *collections: str) -> DataFrame:
    """Add one column per collection: loaded, type, unreadable or blank."""
    path = F.col("file_path")
    return _decoded(files, collections).withColumns(
        {name: _outcome(PROFILES[name].accepts(path)) for name in collections}
    ).drop("text", "blank")


def _conform(df: DataFrame, *more: str) -> DataFrame:
    """Project to the documents layout and ``more`` columns, NULL for what a source does not have."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DOCUMENTS.fields
    ], *more)


def documents_from_files(files: DataFrame, *collections: str, with_skipped: bool = False) -> DataFrame:
    """The documents that the named collections take from a files table, in one scan.

    A file that several collections take becomes one document of each. Tutorials take files
    of registered sources only (see ``with_registry``). ``with_skipped`` adds a column ``outcome``, and the files
    that are taken but blank or unreadable, which have no text.
    """
    path = F.col("file_path")

    def taken(name: str) -> Column:
        accepted = PROFILES[name].accepts(path)
        return accepted & F.col("priority").isNotNull() if name == "tutorials" else accepted

    takers = F.array_compact(F.array(*[F.when(taken(name), F.lit(name)) for name in collections]))
    # The filter on paths stands alone so that it is applied before contents are decoded.
    wanted = files.where(reduce(Column.__or__, [taken(name) for name in collections]))
    decoded = _decoded(wanted, collections)
    outcome = F.when(F.col("text").isNull(), "unreadable").when(F.col("blank"), "blank").otherwise("loaded")
    decoded = decoded.withColumn("outcome", outcome) if with_skipped else decoded.where("not blank")
    loaded = decoded.withColumn("collection", F.explode(takers))
    own = {name: F.col("collection") == name for name in collections}
    stripped = F.col("collection").isin([n for n in collections if PROFILES[n].stripped])
    metadata: dict[str, list[Column]] = {}
    for name in collections:
        for key, value in PROFILES[name].metadata(path).items():
            metadata.setdefault(key, []).append(F.when(own[name], value))
    text = F.when(stripped, strip(F.col("text"))).otherwise(F.col("text"))
    shaped = loaded.select(
        "collection",
        F.concat_ws("|", "source", "file_path").alias("doc_key"),
        (F.when(F.col("outcome") == "loaded", text) if with_skipped else text).alias("text"),
        "file_path",
        *(["outcome"] if with_skipped else []),
        *[F.coalesce(*values).alias(key) for key, values in metadata.items()],
    )
    return _conform(shaped.withColumn("content_hash", content_hash(F.col("text"))), *(["outcome"] if with_skipped else []))


def ingest_stats(files: DataFrame, *collections: str) -> DataFrame:
    """Loaded and skipped counts per collection and source, skips by reason, in one scan.

    The tests collection walks ``tests/`` only, so other files are no skips of it.
    """
    path, outcome = F.col("file_path"), F.col("outcome")
    outcomes = F.array_compact(F.array(*[
        F.when(
            filters.under_tests(path) if name == "tests" else F.lit(True),
            F.struct(F.lit(name).alias("collection"), F.col(name).alias("outcome")),
        )
        for name in collections
    ]))
    return (
        file_outcomes(files, *collections)
        .select("source", F.inline(outcomes))
        .groupBy("collection", "source")
        .agg(
            F.count_if(outcome == "loaded").alias("loaded"),
            F.count_if(outcome != "loaded").alias("skipped"),
            F.count_if(outcome == "type").alias("skipped_type"),
            F.count_if(outcome == "unreadable").alias("skipped_unreadable"),
            F.count_if(outcome == "blank").alias("skipped_blank"),
        )
    )


def documents_from_pages(parsed: DataFrame, source: Column) -> DataFrame:
    """Documents of parsed pages (url, main_text, title) with enough main text."""
    text = F.col("main_text")
    return _conform(parsed.where(long_enough(text)).select(
        F.lit("docs").alias("collection"),
        F.col("url").alias("doc_key"),
        text.alias("text"),
        content_hash(text).alias("content_hash"),
        "url", "title", source.alias("source"),
    ))


def union_documents(*parts: DataFrame) -> DataFrame:
    """All documents of several sources, each brought to the common layout."""
    return reduce(DataFrame.unionByName, [_conform(part) for part in parts])
