"""Sharding: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import prefix_sums, text_of, uniform
from gleaner.session import stored

PART_ROWS = 20_000
BINS = 1024


def _draw(rng: np.random.Generator, left: np.ndarray, rows: int) -> np.ndarray:
    """How many of ``rows`` draws without replacement fall into each shard."""
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, rows, method="marginals")
    # Beyond numpy's range: distinct places among all that are left, counted by shard.
    places = np.zeros(0, np.int64)
    while len(places) < rows:
        more = rng.integers(0, left.sum(), rows - len(places))
        places = np.unique(np.concatenate([places, more]))
    ends = np.cumsum(left)
    return np.bincount(np.searchsorted(ends, places, "right"), minlength=len(left))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each part sends to each shard; shard sizes differ by one at most.

    The extra rows of the larger shards go to the first shards. A part's row is a multivariate
    hypergeometric draw from the room left, which is the law of a uniform permutation.
    """
    total = sum(rows)
    left = np.array([total // shards + (shard < total % shards) for shard in range(shards)], np.int64)
    rng, matrix = np.random.default_rng(seed), []
    for count in rows:
        matrix.append(_draw(rng, left, count))
        left = left - matrix[-1]
    return np.array(matrix).reshape(len(rows), shards)


def shard(
    documents: DataFrame, shards: int = 8, seed: int = 11, part_rows: int = PART_ROWS, tie: Column | None = None,
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, gapless from 0).

    Rows are dealt by hash into parts of about ``part_rows`` rows. The driver sees the count of each part only and draws the
    matrix. Each part is permuted, cut by its row of the matrix and sent; in its shard each row draws again.
    Places within a shard are prefix counts over bins, so that no task holds a whole shard.

    Draws depend on id and text, so reruns agree. Rows equal in both are interchangeable and get
    places of their own. Missing texts and ids are allowed; an empty table gives no rows. Needs doc_id, and text unless ``tie`` is
    given in its place; other columns are kept and move with the rows, except that ``shard`` and ``slot`` are replaced.
    """
    digest = F.md5(text_of(F.col("text"))) if tie is None else tie
    drawn = documents.withColumns({
        "__first": uniform(F.lit(f"{seed}a"), F.col("doc_id"), digest),
        "__second": uniform(F.lit(f"{seed}b"), F.col("doc_id"), digest)})
    parts = max(1, -(-documents.count() // part_rows))
    place = F.pmod(F.xxhash64("doc_id", "__first"), F.lit(parts)).cast("int")
    counts = {row["part"]: row["n"] for row in
              drawn.groupBy(place.alias("part")).agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([counts.get(part, 0) for part in range(parts)], shards, seed)
    ends = stored(documents.sparkSession.createDataFrame(
        [(part, [int(end) for end in np.cumsum(row)]) for part, row in enumerate(matrix)],
        "__at int, __ends array<long>"), "matrix")
    ranked = prefix_sums(
        drawn.withColumn("__part", place), "__part", F.lit(0),
        [F.col("__first"), F.col("__second"), F.col("doc_id")], F.lit(1).cast("long"), "__rank")
    sent = ranked.join(ends, F.col("__part") == F.col("__at")).withColumn(
        "shard", F.size(F.filter("__ends", lambda end: end <= F.col("__rank"))).cast("int"))
    placed = prefix_sums(
        sent, "shard", F.floor(F.col("__second") * BINS).cast("int"),
        [F.col("__second"), F.col("__first"), F.col("doc_id")], F.lit(1).cast("long"), "slot")
    return placed.drop("__first", "__second", "__part", "__at", "__ends", "__rank")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; one for a missing text."""
    return (F.octet_length(text_of(text)) + 1).cast("long")
