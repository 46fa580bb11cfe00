"""Coded vectors: product quantisation, search of the codes, exact ranking of the best.

A vector is cut into parts, and each part is replaced by the number of the nearest of 256 centres: a code has one byte per part in
place of four per entry. The squared distance of a query to a code is the sum of its distances to the centres the code
names; it is worked out for many queries at once by looking the centres up and multiplying matrices, within the search that
exact vectors use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.cells import Cells, lloyd
from gleaner.operators.knn import DISTANCE_DECIMALS, matrix, top_k
from gleaner.session import small_side, stored

CENTRES = 256
TRAIN_ROWS = 16_384  # rows that place the centres, about
RERANK = 8  # candidates per hit asked for
_VECTOR = T.ArrayType(T.FloatType())


@dataclass(frozen=True)
class Codebooks:
    """Centres of each part: part, number, entry. The last part may be filled up with zeros."""

    centres: np.ndarray
    dim: int

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, width = self.centres.shape
        filled = np.zeros((len(vectors), parts * width))
        filled[:, :self.dim] = vectors
        return filled.reshape(len(vectors), parts, width)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """A byte per part."""
        cut = self._parts(vectors)
        return np.stack([Cells(centres).gaps(cut[:, at]).argmin(axis=1) for at, centres in enumerate(self.centres)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vector that stands for each code."""
        found = self.centres[np.arange(len(self.centres))[None, :], codes]
        return found.reshape(len(codes), -1)[:, :self.dim]


def fit_codebooks(vectors: DataFrame, parts: int = 16, id_col: str = "chunk_id", vec_col: str = "embedding", train_rows: int = TRAIN_ROWS) -> Codebooks:
    """Fit centres on a sample of about ``train_rows`` rows by hash of their id, a task per part.

    Vectors are of one length; missing ones are left out. A sample of fewer rows than 256 gives fewer centres.
    """
    present = vectors.where(F.size(vec_col) > 0)
    n_rows = present.count()
    if not n_rows:
        raise ValueError("no vectors to fit codes on")
    dim = present.select(F.size(vec_col).alias("dim")).first()["dim"]
    parts = min(parts, dim)
    width = -(-dim // parts)
    share = min(1.0, train_rows / n_rows)
    drawn = present.where(F.pmod(F.xxhash64(F.lit("codes"), id_col), F.lit(10**9)) <= int(share * 10**9))
    pieces = drawn.select(F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda at: F.slice(F.col(vec_col), at * width + 1, width))).alias("part", "piece"))

    def place(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        pieces = np.zeros((group.num_rows, width))
        own = matrix(group.column("piece"))
        pieces[:, :own.shape[1]] = own
        centres = lloyd(pieces, CENTRES, seed=part)
        return pa.table({"part": pa.array([part] * len(centres), pa.int32()), "centre": pa.array(centres.tolist(), pa.list_(pa.float32()))})

    found: dict[int, list] = {}
    for row in pieces.groupBy("part").applyInArrow(place, "part int, centre array<float>").collect():  # 256 rows a part
        found.setdefault(row["part"], []).append(row["centre"])
    centres = np.zeros((parts, CENTRES, width))
    for part in range(parts):  # where there are fewer centres, or only zeros to a part, the first one fills up
        own = np.array(found.get(part) or [[0.0] * width])
        centres[part] = own[np.minimum(np.arange(CENTRES), len(own) - 1)] if len(own) < CENTRES else own
    return Codebooks(centres, dim)


def encode(vectors: DataFrame, books: Codebooks, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` with a column ``code`` in place of the vector; missing vectors are left out. No shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("binary")
    def coded(column: pa.Array) -> pa.Array:
        return pa.array([code.tobytes() for code in shared.value.encode(matrix(column))], pa.binary()) if len(column) else pa.array([], pa.binary())

    return vectors.where(F.size(vec_col) > 0).withColumn("code", coded(vec_col)).drop(vec_col)


def coded_top_k(
    coded: DataFrame, vectors: DataFrame, queries: DataFrame, books: Codebooks, id_col: str = "chunk_id", vec_col: str = "embedding",
    by: str | None = None, rerank: int = RERANK,
) -> DataFrame:
    """Approximate top-k (squared L2) of queries (query_id, embedding, k): query_id, id, distance, rank.

    Codes alone are searched for ``rerank`` times k candidates of a query, whose vectors are then read and ranked as an exact search
    ranks them. ``coded`` has the id, ``code`` and, with ``by``, that column; ``vectors`` the id and the vector.
    """
    shared = coded.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf(_VECTOR)
    def decoded(column: pa.Array) -> pa.Array:
        parts = len(shared.value.centres)
        codes = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)
        rows = shared.value.decode(codes).astype(np.float32)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    @F.arrow_udf("double")
    def gap(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array(((matrix(one) - matrix(two)) ** 2).sum(axis=1) if len(one) else [], pa.float64())

    # Told to be not deterministic: the search's filter of missing vectors else decodes again in a worker of its own.
    approximate = coded.withColumn("_vector", decoded.asNondeterministic()("code"))
    candidates = stored(top_k(approximate, queries.withColumn("k", F.col("k") * rerank), id_col, "_vector", by=by).select(
        "query_id", id_col), "candidates")
    asked = small_side(queries.select("query_id", F.col("embedding").alias("_query"), "k"), 4096)
    pairs = vectors.select(id_col, F.col(vec_col).alias("_row")).join(candidates, id_col).join(asked, "query_id")
    best = Window.partitionBy("query_id").orderBy(F.round("distance", DISTANCE_DECIMALS), id_col)
    return pairs.select("query_id", id_col, gap("_row", "_query").alias("distance"), "k").withColumn(
        "rank", F.row_number().over(best)).where("rank <= k").drop("k")
