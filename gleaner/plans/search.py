"""Search: query rows to hits, rendered text and statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.queries import (
    HIT_RULE, format_query, hit_label, plain_answer, render_hit, result_count, score, tool_collection,
)
from gleaner.operators.embed import BatchFunction, embed_text
from gleaner.operators.knn import distance_bounds, top_k
from gleaner.plans.build import model_fingerprint
from gleaner.plans.layout import cell_search, merged, place_of
from gleaner.plans.status import health, status_of
from gleaner.schema import COLLECTIONS, METADATA
from gleaner.session import small_side, stored
from gleaner.sources import index

# An index of more scan tasks than this is searched in one bucket first.
BOUND_PARTITIONS = 256
# Winners of about 200 bytes each that are broadcast: at most about 64 MB.
BROADCAST_WINNERS = 327_680


def prepare_queries(
    queries: DataFrame, catalog: DataFrame, factory: Callable[[], BatchFunction]
) -> DataFrame:
    """Embedded queries of the collections that exist: query_id, collection, k, embedding.

    The prefix follows the model a collection was built with.
    """
    models = small_side(catalog.select("collection", "embed_model"))
    asked = queries.join(models, "collection").select(
        "query_id", "collection",
        result_count(F.col("n_results")).alias("k"),
        format_query(F.col("query"), F.col("embed_model")).alias("text"),
    )
    return embed_text(asked, factory).drop("text")


def check_model(asked: Iterable[index.Version], factory: Callable[[], BatchFunction]) -> None:
    """Refuse a model that is not that of the collections asked for; a factory without a name passes."""
    name = getattr(factory, "name", None)
    for version in asked if name is not None else ():
        index.check_model(version, name, model_fingerprint(factory))


def label_hits(hits: DataFrame) -> DataFrame:
    """Add score and label to hits that carry distance and metadata."""
    return hits.withColumn("score", score(F.col("distance"))).withColumn(
        "label",
        hit_label(F.col("file_path"), F.col("url"), F.col("source"), F.col("doc_type")),
    )


def search(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    factory: Callable[[], BatchFunction],
    metric: str = "l2sq",
) -> DataFrame:
    """Hits of a batch of queries (query_id, collection, query, n_results).

    Ranking reads ids and vectors only: those of a collection that is laid out by cells where a hit can be, and what was
    added to it since; of others all. The winners are written to the shared folder, and text and metadata are joined to them
    afterwards: with their true size at hand Spark broadcasts them, reads only the buckets they name, and shuffles neither vectors
    nor texts of the index. All of a search reads one version of each collection.
    """
    versions = index.versions(spark, root)
    known = index.catalog_rows(spark, versions.values())
    # As many rows as there are collections.
    names = [row["collection"] for row in queries.select("collection").distinct().collect()]
    current = [versions[name] for name in names if name in versions]
    check_model(current, factory)
    prepared = stored(prepare_queries(queries, known, factory), "queries")
    laid_out = [version for version in current if version.layout] if metric == "l2sq" else []
    chunks = index.live(spark, root, current, beside_layout=bool(laid_out))
    place = place_of(F.col("chunk_id"), F.col("bucket")).alias("place")
    vectors = chunks.select("collection", "bucket", place, "embedding")
    bounded = prepared
    if vectors.rdd.getNumPartitions() > BOUND_PARTITIONS:
        bounded = distance_bounds(prepared, vectors.where("bucket = 0"), id_col="place", by="collection", metric=metric)
    ranked = top_k(vectors, bounded, "place", by="collection", metric=metric)
    if laid_out:
        ranked = merged([ranked, cell_search(spark, root, laid_out, prepared)], prepared)
    split = F.split("place", r"\|")
    winners = stored(ranked.join(prepared.select("query_id", "collection"), "query_id").select(
        "query_id", "collection", split[0].alias("chunk_id"), split[1].cast("int").alias("bucket"), "distance", "rank"), "winners")
    found = winners.where("rank >= 1")  # all of them; the comparison tells the planner that they are worth pruning by
    if winners.limit(BROADCAST_WINNERS + 1).count() <= BROADCAST_WINNERS:
        found = F.broadcast(found)
    whole = index.live(spark, root, current)
    details = whole.where(F.col("collection").isin(names)).select(
        "collection", "bucket", "chunk_id", "chunk_no", "text", *METADATA.names)
    return label_hits(found.join(details, ["collection", "bucket", "chunk_id"]).drop("bucket"))


def render(hits: DataFrame) -> DataFrame:
    """One text per query, hits in rank order; at most twenty rows meet in a group."""
    blocks = hits.select(
        "query_id", F.struct("rank", render_hit(F.col("label"), F.col("score"), F.col("text")).alias("block")).alias("hit")
    )
    ordered = F.array_sort(F.collect_list("hit"))
    return blocks.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda hit: hit["block"]), HIT_RULE).alias("rendered")
    )


def answers(queries: DataFrame, hits: DataFrame, catalog: DataFrame, names: DataFrame) -> DataFrame:
    """One text per query (query_id, rendered): its hits, or why there are none.

    ``names`` (collection) are the collections that may be asked for, built or not.
    """
    known = health(catalog, names).select(F.col("collection").alias("known"), "n_chunks")
    tool = F.col("tool") if "tool" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", "collection", tool.alias("tool"))
    joined = asked.join(known, F.col("collection") == F.col("known"), "left").join(render(hits), "query_id", "left")
    status = status_of(F.col("known"), F.col("n_chunks"), F.col("rendered").isNotNull())
    plain = plain_answer(status, F.col("collection"), F.col("tool"))
    return joined.select("query_id", F.coalesce("rendered", plain).alias("rendered"))


def search_text(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    factory: Callable[[], BatchFunction],
    names: Sequence[str] = COLLECTIONS,
) -> DataFrame:
    """A text for every query; a column ``tool`` names the collection by the tool that reads it."""
    if "tool" in queries.columns:
        queries = queries.withColumn("collection", tool_collection(F.col("tool")))
    hits = search(spark, root, queries, factory)
    known = spark.createDataFrame([(name,) for name in names], "collection string")
    return answers(queries, hits, index.catalog(spark, root), known)
