"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import union_all
from gleaner.session import stored

BLOCK_ROWS = 2048
QUERY_ROWS = 512
SLICE_ROWS = 16_384


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, weights): each component x becomes floor(scale * x), a long number; one beyond these becomes the largest or smallest.

    Vectors that are missing or hold a missing or non-finite component, and rows without an id, are left out.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return embeddings.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("weights"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of weights, short ones filled with 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all queries with all rows, one term after another.

    The postings of a term are the rows with a weight other than 0. Each query that has the term scatters its weight
    times the postings into its score row. Sums stay exact: 32-bit floats while no sum can pass 2**24,
    64-bit integers otherwise. A sum that no 64-bit integer holds is given modulo 2**64.
    """
    terms = min(queries.shape[1], rows.shape[1])
    if not terms or not len(rows) or not len(queries):
        return np.zeros((len(queries), len(rows)), np.int64)
    bound = int(np.abs(queries).max()) * int(np.abs(rows).max()) * terms
    kind = np.float32 if bound < 2**24 else np.int64
    scores = np.zeros((len(queries), len(rows)), kind)
    by_term, asked = np.ascontiguousarray(rows.T).astype(kind), queries.astype(kind)
    scratch = np.empty_like(scores)
    for term in range(terms):
        postings, askers = np.flatnonzero(by_term[term]), np.flatnonzero(asked[:, term])
        if 2 * len(postings) > len(rows) and 2 * len(askers) > len(asked):
            np.multiply(asked[:, term, None], by_term[term][None, :], out=scratch)
            scores += scratch
        elif len(postings) and len(askers):
            scores[np.ix_(askers, postings)] += np.outer(asked[askers, term], by_term[term][postings])
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, row place and score of each query's k best in a block whose ``ids`` ascend."""
    lowest = np.finfo(scores.dtype).min if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    scores[ids[None, :] == own[:, None]] = lowest
    size = scores.shape[1]
    if size > k:
        edge = np.partition(scores, size - k, axis=1)[:, size - k]
        which, column = np.nonzero((scores >= edge[:, None]) & (scores > lowest))
    else:
        which, column = np.nonzero(scores > lowest)
    value = scores[which, column].astype(np.int64)
    keep = _first(which, ids[column], value, k)
    return which[keep], column[keep], value[keep]


def _first(which: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query."""
    order = np.lexsort((ids, -value, which))
    sorted_by = which[order]
    begins = np.searchsorted(sorted_by, sorted_by)
    return order[np.arange(len(order)) - begins < k]


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    which, ids, value = (np.concatenate([part[at] for part in parts]) for at in range(3))
    keep = _first(which, ids, value, k)
    return which[keep], ids[keep], value[keep]


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Every query's ``k`` highest scores over all rows but those of its own id.

    Both sides are (vec_id, weights), as from :func:`quantised`. Ties go to the smaller id; a query with fewer candidates
    gets them all. Vectors of different lengths are compared over their common terms. An id that several
    query rows share is answered once per row.

    Queries are cut by hash into slices of about ``SLICE_ROWS`` rows, the only thing that is broadcast; each slice
    takes one pass over the candidates where they lie. A task scores blocks of ``BLOCK_ROWS`` rows and emits its k best per
    query; a window merges them.
    """
    known = stored(queries.select("vec_id", "weights"), "queries")
    slices = max(1, -(-known.count() // SLICE_ROWS))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(slices))
    found = [_pass(candidates, known.filter(part == at), k, at) for at in range(slices)]
    rank = Window.partitionBy("slice", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return union_all(found).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _pass(candidates: DataFrame, queries: DataFrame, k: int, at: int) -> DataFrame:
    rows = queries.collect()  # one slice
    width = max((len(row["weights"]) for row in rows), default=0)
    matrix = np.zeros((len(rows), width), np.int64)
    for place, row in enumerate(rows):
        matrix[place, :len(row["weights"])] = row["weights"]
    sent = candidates.sparkSession.sparkContext.broadcast((np.array([row["vec_id"] for row in rows], np.int64), matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = sent.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(begin, BLOCK_ROWS)
                ids = block.column("vec_id").to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                ids, terms = ids[order], _matrix(block.column("weights"))[order]
                for first in range(0, len(asked), QUERY_ROWS):
                    own = query_ids[first:first + QUERY_ROWS]
                    which, column, value = _best(accumulate(asked[first:first + QUERY_ROWS], terms), ids, own, k)
                    best.append((which + first, ids[column], value))
            if sum(len(part[0]) for part in best) > 4 * k * max(1, len(asked)):
                best = [_merge(best, k)]
        if best:
            which, ids, value = _merge(best, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which.astype(np.int64)), pa.array(query_ids[which]), pa.array(ids), pa.array(value)],
                names=["query_row", "query_id", "vec_id", "score"])

    return candidates.select("vec_id", "weights").mapInArrow(
        score, "query_row long, query_id long, vec_id long, score long").withColumn("slice", F.lit(at))
