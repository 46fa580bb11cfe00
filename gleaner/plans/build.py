"""Index builds: documents to chunks to vectors to a collection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.chunk import chunk_documents, chunk_id
from gleaner.operators.embed import BatchFunction, HashedTfIdf, embed_text, fit_hashed_tfidf
from gleaner.schema import CHUNK_OVERLAP, CHUNK_TOKENS, METADATA
from gleaner.session import stored
from gleaner.sources import index

_EMBED_TEXT = "_embed_text"


def chunks_of(
    documents: DataFrame, mode: str = "window", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of documents in the common layout, with their deterministic ids."""
    chunked = chunk_documents(documents, mode, size, overlap)
    place = F.coalesce("file_path", "url", "doc_key")
    return chunked.withColumn(
        "chunk_id",
        chunk_id(F.col("collection"), F.coalesce("repo", "source"), place, F.col("chunk_no")),
    )


def embed_chunks(
    chunks: DataFrame, factory: Callable[[], BatchFunction], model_name: str, with_metadata: bool = False
) -> DataFrame:
    """Add embedding and embed_model; metadata lines join the embedded text on request."""
    text = F.col("text")
    if with_metadata:
        lines = [
            F.when(F.col(name) != "", F.concat(F.lit(f"{name}: "), F.col(name).cast("string")))
            if name != "priority" else F.concat(F.lit("priority: "), F.col(name).cast("string"))
            for name in METADATA.names
        ]
        text = F.concat_ws("\n", *lines, text)
    return (
        embed_text(chunks.withColumn(_EMBED_TEXT, text), factory, _EMBED_TEXT)
        .drop(_EMBED_TEXT)
        .withColumn("embed_model", F.lit(model_name))
    )


def single_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with one row per collection and key: of rows that repeat a key, the one of the smallest content hash.

    Keys alone are counted; texts meet only where a key does repeat.
    """
    key = ["collection", "doc_key"]
    repeated = stored(documents.groupBy(*key).count().where("count > 1").select(*key), "repeated")
    if repeated.isEmpty():
        return documents
    row = F.struct(*documents.columns)
    single = documents.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(row, F.struct("content_hash", F.md5(F.to_json(row)))).alias("row"))
    return documents.join(repeated, key, "left_anti").select(*documents.columns).unionByName(single.select("row.*"))


def model_fingerprint(factory: Callable[[], BatchFunction]) -> str | None:
    """What tells a model from another of the same name, if the factory can tell."""
    return getattr(factory, "fingerprint", None)


def build_index(
    documents: DataFrame,
    root: str,
    names: Sequence[str],
    factory: Callable[[], BatchFunction],
    model_name: str,
    mode: str = "rebuild",
    chunking: str = "window",
    with_metadata: bool = False,
    n_buckets: int = index.DEFAULT_BUCKETS,
    size: int = CHUNK_TOKENS,
    overlap: int = CHUNK_OVERLAP,
) -> dict[str, tuple[int, int]]:
    """Chunk, embed and store the documents of the named collections, in one job; chunks and documents written to each.

    The one shuffle moves documents to their buckets; chunks and vectors stay where they are made. Of rows
    that repeat a key within ``documents`` one is taken. The chunk options stay with the collection: an append to one that
    exists uses its own, as every refresh does.
    """
    options = index.Options(chunking, size, overlap, with_metadata)
    if mode == "append":
        current = index.versions(documents.sparkSession, root)
        known = next((current[name] for name in names if name in current), None)
        if known is not None:
            n_buckets, options = known.n_buckets, known.options
    own = single_documents(documents.where(F.col("collection").isin(*names)))

    def made(rows: DataFrame) -> DataFrame:
        return embedded_chunks(index.gather(rows, n_buckets).drop("bucket"), factory, model_name, options)

    if mode == "append":
        return index.append(own, root, names, model_name, n_buckets, model_fingerprint(factory), options, made)
    return index.write_index(made(own), root, names, model_name, mode, n_buckets, model_fingerprint(factory), options)


def embedded_chunks(
    documents: DataFrame, factory: Callable[[], BatchFunction], model_name: str, options: index.Options
) -> DataFrame:
    """Chunks of documents with their vectors, by the options of a collection; no shuffle."""
    chunks = chunks_of(documents, options.chunking, options.size, options.overlap)
    return embed_chunks(chunks, factory, model_name, options.with_metadata)


def fit_model(documents: DataFrame, root: str, options: index.Options = index.Options()) -> HashedTfIdf:
    """Fit the default embedder on the chunks of ``documents`` and store it beside the index."""
    model = fit_hashed_tfidf(chunks_of(documents, options.chunking, options.size, options.overlap))
    save_model(documents.sparkSession, root, model)
    return model


def save_model(spark: SparkSession, root: str, model: HashedTfIdf) -> None:
    """Store a model under its fingerprint, and as the one that new collections take."""
    row = spark.createDataFrame([(model.name, list(model.weights))], "name string, weights array<double>").coalesce(1)
    for path in (f"models/{model.fingerprint}", "model"):
        row.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{path}")


def load_model(spark: SparkSession, root: str, fingerprint: str | None = None) -> HashedTfIdf:
    """The stored embedder, or the one with this fingerprint: queries must use the weights the chunks were built with."""
    path = "model" if fingerprint is None else f"models/{fingerprint}"
    row = spark.read.parquet(f"{root.rstrip('/')}/{path}").first()
    return HashedTfIdf(tuple(row["weights"]))
