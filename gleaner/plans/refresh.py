"""Incremental refresh: only new and changed documents are chunked and embedded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.embed import BatchFunction
from gleaner.plans.build import embedded_chunks, model_fingerprint, single_documents
from gleaner.schema import METADATA
from gleaner.session import stored
from gleaner.sources import index


@dataclass(frozen=True)
class RefreshCounts:
    """Documents added, changed and removed, and by how many chunks the collection grew.

    A blank document counts as added each time, as it leaves no chunk to compare with.
    """

    added: int
    changed: int
    removed: int
    chunks: int


def changes(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Status per doc_key of two (doc_key, content_hash) tables.

    ``incoming`` is the whole new snapshot: a key it lacks is removed.
    """
    old = current.select("doc_key", F.col("content_hash").alias("old_hash"))
    new = incoming.select("doc_key", F.col("content_hash").alias("new_hash"))
    return old.join(new, "doc_key", "full").select(
        "doc_key",
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("unchanged").alias("change"),
    )


def metadata_hash(rows: DataFrame) -> Column:
    """One value for all metadata of a row; a column that is absent counts as NULL."""
    return F.md5(F.to_json(F.struct(*[
        (F.col(field.name) if field.name in rows.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in METADATA.fields
    ])))


def refresh(
    documents: DataFrame,
    root: str,
    name: str,
    factory: Callable[[], BatchFunction],
    model_name: str,
    full_snapshot: bool = True,
    options: index.Options = index.Options(),
    sources: DataFrame | None = None,
    unreadable: DataFrame | None = None,
) -> RefreshCounts:
    """Bring one collection up to date with ``documents``, in one commit; what it changed.

    Keys, text hashes and metadata are compared on the first chunk of each document, so neither
    texts nor vectors of the index are read for that. Only the chunks of new and changed documents and the keys
    of changed and removed ones are written, whatever else their buckets hold. Running it again changes nothing. With
    ``full_snapshot`` the documents that are no longer there are dropped; ``sources`` (source)
    limits that to the repositories, else sources, that the snapshot is of, and documents whose key is in
    ``unreadable`` (doc_key) stay as they were. ``options`` hold for a collection that is new. Of rows that repeat a key one is taken.
    """
    spark = documents.sparkSession
    fingerprint = model_fingerprint(factory)
    old = index.versions(spark, root).get(name)
    if old is None:
        old = index.Version(name, 0, model_name, fingerprint, index.DEFAULT_BUCKETS, options)
    index.check_model(old, model_name, fingerprint)
    indexed = index.live(spark, root, [old])
    current = indexed.where("chunk_no = 0").select(
        "doc_key", "content_hash", metadata_hash(indexed).alias("metadata_hash"), F.coalesce("repo", "source").alias("source"))
    single = single_documents(documents.where(F.col("collection") == name))
    incoming = single.withColumn("metadata_hash", metadata_hash(documents))
    version = ["doc_key", "content_hash", "metadata_hash"]
    keys = incoming.select(*version)

    # Keys first, written out: when few documents changed, Spark broadcasts the keys and
    # the texts are scanned without a shuffle.
    outdated = current.join(keys, version, "left_anti").select("doc_key", "source")
    told = keys.select("doc_key")
    changed = outdated.join(told, "doc_key", "left_semi").select("doc_key", F.lit(False).alias("removed"))
    if full_snapshot:
        gone = outdated.join(told, "doc_key", "left_anti")
        if sources is not None:
            gone = gone.join(sources.select("source"), "source", "left_semi")
        if unreadable is not None:
            gone = gone.join(unreadable.select("doc_key"), "doc_key", "left_anti")
        changed = changed.unionByName(gone.select("doc_key", F.lit(True).alias("removed")))
    outdated = stored(changed, "outdated")
    fresh_keys = stored(keys.join(current.select(*version), version, "left_anti"), "fresh")
    counts = outdated.agg(F.count_if(F.col("removed")).alias("removed"), F.count_if(~F.col("removed")).alias("changed")).first()
    n_fresh = fresh_keys.count()
    if not (n_fresh or counts["removed"] or counts["changed"]) and old.number:
        return RefreshCounts(0, 0, 0, 0)
    fresh = incoming.join(fresh_keys, version).drop("metadata_hash")
    gathered = index.gather(fresh, old.n_buckets).drop("bucket")
    chunks = embedded_chunks(gathered, factory, model_name, old.options)
    new = index.replace_documents(old, outdated, chunks, root)
    return RefreshCounts(n_fresh - counts["changed"], counts["changed"], counts["removed"], new.n_chunks - old.n_chunks)
