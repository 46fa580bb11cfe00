"""Documents to packed training sequences, in five stages that each write their table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, mixing, near_dup, packing, toxicity
from gleaner.llm.common import table, text_of
from gleaner.session import ship_package, stored

SMALL_DROPPED = 1_000_000  # rows of an id and a digest: at most about 120 MB

# The last stage packs with a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``docs`` but those of ``dropped``, which is broadcast if it has few rows."""
    dropped = stored(dropped.select(*[F.col(name).alias(f"dropped_{name}") for name in on]).distinct(), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= SMALL_DROPPED else dropped
    match = [docs[name].eqNullSafe(F.col(f"dropped_{name}")) for name in on]
    return docs.join(side, match, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely clean than not; an empty or missing text is clean."""
    return toxicity.reject_toxic(docs, toxicity.fit_severity(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that repeat id and text, one."""
    ship_package(spark)
    keys = stored(exact_dedup.keyed(docs), "keys")
    stream = spark.readStream.schema(keys.schema).parquet(keys.inputFiles()[0].rsplit("/", 1)[0]) \
        if keys.inputFiles() else None
    if stream is None:
        return docs
    told = stored(exact_dedup.deduplicate(docs, stream), "told")
    name = "__digest"
    marked = docs.withColumns({
        name: exact_dedup.sha256(exact_dedup.normalised(F.col("text"))),
        "__points": F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")})
    dropped = told.filter(~F.col("kept")).select(
        "doc_id", F.col("digest").alias(name), F.col("n_points").alias("__points"))
    left = _without(marked, dropped, ["doc_id", name, "__points"])
    again = told.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1")
    if not again.isEmpty():
        left = left.dropDuplicates(["doc_id", name])
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, a missing id last, then of the smallest digest.

    Documents are told apart by id and digest of the text; of rows that repeat both, one stays. Rows without words all stay.
    """
    name = "__digest"
    digest = exact_dedup.sha256(text_of(F.col("text")))
    told = stored(near_dup.row_fates(docs, digest), "told")
    left = _without(docs.withColumn(name, digest), told.filter(~F.col("kept")).select(
        "doc_id", F.col("mark").alias(name)), ["doc_id", name])
    again = stored(told.filter("kept").groupBy("doc_id", F.col("mark").alias(name)).count().filter("count > 1"), "again")
    if not again.isEmpty():
        single = left.groupBy("doc_id", name).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*", name)
        left = _without(left, again, ["doc_id", name]).select(*docs.columns, name).unionByName(
            single.join(again.select(F.col("doc_id").alias("again_id"), F.col(name).alias("again_digest")),
                        single["doc_id"].eqNullSafe(F.col("again_id")) & (single[name] == F.col("again_digest")), "left_semi"))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("mixing", mix_sources), ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
