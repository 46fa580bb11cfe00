"""Whole index jobs, one per collection: scan, filter, chunk, embed, store.

Each takes ``mode`` ("append", "rebuild" or "refresh") and fails when it finds nothing to
index. The embedder is the model stored beside the index; the first job fits it. Each returns a
report of what it loaded, skipped and wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.urls import site_base
from gleaner.operators.crawl import reachable
from gleaner.operators.documents import (
    PROFILES, documents_from_files, documents_from_pages, preferred_branch, with_registry,
)
from gleaner.operators.embed import HashedTfIdf
from gleaner.operators.filters import select_sources, under_tests
from gleaner.operators.pages import parse_pages
from gleaner.plans.build import build_index, fit_model, load_model
from gleaner.plans.refresh import RefreshCounts, refresh
from gleaner.schema import DEFAULT_MAX_PRIORITY
from gleaner.session import small_side, stored
from gleaner.sources import index
from gleaner.sources.files import list_files, read_files
from gleaner.sources.registry import scan_registry


def stored_model(documents: DataFrame, root: str, name: str | None = None, options: index.Options = index.Options()) -> HashedTfIdf:
    """The model of a collection, or the index's for one that is new; fitted on the chunks of ``documents`` if there is none yet."""
    version = index.versions(documents.sparkSession, root).get(name) if name else None
    try:
        return load_model(documents.sparkSession, root, version.fingerprint if version else None)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return fit_model(documents, root, options)


@dataclass(frozen=True)
class JobReport:
    """What an index job did. ``skipped`` (source, file_path, reason) is a table of the files it took no document from,
    without those of a type that the collection does not take, which are only counted."""

    loaded: int
    skipped_type: int
    skipped_blank: int
    skipped_unreadable: int
    added: int
    changed: int
    removed: int
    chunks: int  # by which the collection grew, or, rebuilt, has
    skipped: DataFrame | None = None

    @property
    def n_skipped(self) -> int:
        return self.skipped_type + self.skipped_blank + self.skipped_unreadable


def index_documents(
    documents: DataFrame, root: str, name: str, mode: str = "append", sources: DataFrame | None = None,
    unreadable: DataFrame | None = None, options: index.Options = index.Options(),
) -> RefreshCounts:
    """Bring documents into one collection of an index; what changed.

    A refresh drops what is no longer there, of ``sources`` (source) only if they are given, and keeps documents whose key is
    in ``unreadable`` (doc_key). ``options`` say how a collection that is new or rebuilt is chunked and embedded.
    """
    if documents.isEmpty():
        raise ValueError(f"no documents for collection {name!r}")
    model = stored_model(documents, root, None if mode == "rebuild" else name, options)
    if mode == "refresh":
        return refresh(documents, root, name, model, model.name, options=options, sources=sources, unreadable=unreadable)
    counts = build_index(
        documents, root, [name], model, model.name, mode, options.chunking, options.with_metadata, size=options.size,
        overlap=options.overlap)
    n_chunks, n_documents = counts[name]
    return RefreshCounts(n_documents, 0, 0, n_chunks)


def _scan(manifest: DataFrame, name: str) -> DataFrame:
    """Contents of the files the collection accepts; no others are read."""
    accepts: Column = PROFILES[name].accepts(F.col("file_path"))
    return read_files(manifest, accepts)


def _index_read(
    read: DataFrame, manifest: DataFrame, root: str, name: str, mode: str, sources: DataFrame, options: index.Options,
) -> JobReport:
    """Index what was read of the files of a manifest; ``read`` are documents with an outcome each, written once."""
    read = stored(read, "read")
    path = F.col("file_path")
    walked = manifest.where(under_tests(path)) if name == "tests" else manifest
    n_other = walked.where(~PROFILES[name].accepts(path)).count()
    counts = read.agg(*[F.count_if(F.col("outcome") == outcome).alias(outcome) for outcome in ("loaded", "blank", "unreadable")]).first()
    documents = read.where("outcome = 'loaded'").drop("outcome")
    left = read.where("outcome <> 'loaded'")
    unreadable = left.where("outcome = 'unreadable'").select("doc_key") if counts["unreadable"] else None
    done = index_documents(documents, root, name, mode, sources, unreadable, options)
    return JobReport(counts["loaded"], n_other, counts["blank"], counts["unreadable"], done.added, done.changed, done.removed, done.chunks,
                     left.select(F.substring_index("doc_key", "|", 1).alias("source"), "file_path", F.col("outcome").alias("reason")))


def chosen_checkouts(checkouts: DataFrame) -> DataFrame:
    """Checkouts (source, root, branch) of one branch per source: main, else master, else an active one.

    Without a column ``active`` any branch counts as active; the first by name is taken then.
    """
    active = F.col("active") if "active" in checkouts.columns else F.lit(True)
    best = preferred_branch(checkouts.select("source", "branch", active.alias("active"))).select(
        F.col("source").alias("best_source"), F.col("branch").alias("best_branch"))
    same = F.col("source").eqNullSafe(F.col("best_source")) & F.col("branch").eqNullSafe(F.col("best_branch"))
    return checkouts.join(best, same, "left_semi")


def index_files(
    spark: SparkSession, root: str, checkouts: DataFrame, name: str, mode: str = "append", options: index.Options = index.Options(),
) -> JobReport:
    """Index code, docs or tests from checked-out trees (source, root, branch), one branch per source.

    A file that cannot be read is reported; a refresh leaves what the index has of it.
    """
    checkouts = chosen_checkouts(checkouts)
    manifest = list_files(checkouts)
    files = _scan(manifest, name).join(
        small_side(checkouts.select("source", "branch").distinct()), "source"
    )
    read = documents_from_files(files, name, with_skipped=True)
    return _index_read(read, manifest, root, name, mode, checkouts.select("source"), options)


def index_tutorials(
    spark: SparkSession,
    root: str,
    registry_path: str,
    checkouts: DataFrame,
    mode: str = "append",
    max_priority: int = DEFAULT_MAX_PRIORITY,
    include_prerequisites: bool = False,
    options: index.Options = index.Options(),
) -> JobReport:
    """Index the checked-out trees (source, root) of the selected registry entries."""
    selected = select_sources(scan_registry(spark, registry_path), max_priority, include_prerequisites)
    manifest = with_registry(list_files(checkouts), selected)
    files = with_registry(_scan(manifest, "tutorials"), selected)
    read = documents_from_files(files, "tutorials", with_skipped=True)
    return _index_read(read, manifest, root, "tutorials", mode, checkouts.select("source"), options)


def _host() -> Column:
    return F.regexp_replace(site_base(F.col("url")), r"^[^:]*://|/$", "")


def crawled_documents(
    pages: DataFrame, seeds: DataFrame, max_depth: int | None = None, base: Column | None = None
) -> DataFrame:
    """Documents of the pages (url, html) that a crawl from ``seeds`` (url) reaches.

    Links are followed below ``base``, an address in each page's row; by default the page's own site.
    """
    parsed = stored(parse_pages(pages, base), "parsed")
    reached = reachable(parsed, seeds, max_depth).where("kept").select("url")
    return documents_from_pages(parsed.join(reached, "url", "left_semi"), _host())


def index_pages(
    spark: SparkSession, root: str, pages: DataFrame, seeds: DataFrame, mode: str = "append", base: Column | None = None,
    max_depth: int | None = None, options: index.Options = index.Options(),
) -> JobReport:
    """Index the reachable part of a page snapshot as docs; pages that are reached but too short are no documents."""
    documents = stored(crawled_documents(pages, seeds, max_depth, base), "documents")
    done = index_documents(documents, root, "docs", mode, seeds.select(_host().alias("source")), options=options)
    return JobReport(documents.count(), 0, 0, 0, done.added, done.changed, done.removed, done.chunks)
