"""Nearest-neighbour search over an index laid out by KMeans cells.

Two ways to read it. ``approximate_top_k`` looks only into the cells nearest to a query.
``pruned_top_k`` is exact: it looks there first, and then into every further cell that the
triangle inequality cannot rule out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.knn import SLACK, distance_bounds, matrix, top_k
from gleaner.session import stored

# Cells are part of every task's closure: at most 32 MB of centres at 1,024 dimensions.
MAX_CELLS = 4_096
_PLACE = T.StructType([
    T.StructField("cell", T.IntegerType()),
    T.StructField("cell_distance", T.DoubleType()),
])


@dataclass(frozen=True)
class Cells:
    """Cell centres, one row each."""

    centres: np.ndarray

    def gaps(self, vectors: np.ndarray) -> np.ndarray:
        """Distance (not squared) of every vector to every centre."""
        squared = (
            (vectors**2).sum(1)[:, None] + (self.centres**2).sum(1)[None, :]
            - 2.0 * vectors @ self.centres.T
        )
        return np.sqrt(np.maximum(squared, 0.0))


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    """What ``np.unique(rows, axis=0)`` gives, by comparing rows as bytes that sort as their numbers do."""
    if not rows.size:
        return rows[:1]
    numbers = np.ascontiguousarray(rows, np.float64) + 0.0  # one zero
    bits = numbers.view(np.uint64)
    bits = np.where(bits >> 63, ~bits, bits | np.uint64(1 << 63)).astype(">u8")
    whole = bits.view(np.dtype((np.void, 8 * rows.shape[1]))).ravel()
    return numbers[np.unique(whole, return_index=True)[1]]


def lloyd(rows: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """At most ``k`` KMeans centres of a few rows."""
    distinct = distinct_rows(rows)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds if len(centres) < len(distinct) else 0):
        own = Cells(centres)
        nearest = np.concatenate([own.gaps(rows[at:at + 1024]).argmin(axis=1) for at in range(0, len(rows), 1024)])
        filled, place = np.unique(nearest, return_inverse=True)
        order, sizes = np.argsort(place, kind="stable"), np.bincount(place)
        sums = np.stack([rows[own_rows].sum(axis=0) for own_rows in np.split(order, np.cumsum(sizes)[:-1])])
        centres = sums / sizes[:, None]
    return centres.astype(np.float32)


def assign_cells(index: DataFrame, cells: Cells, vec_col: str = "embedding") -> DataFrame:
    """Add ``cell`` and ``cell_distance`` (to its centre); no shuffle."""

    @F.arrow_udf(_PLACE)
    def place(vectors: pa.Array) -> pa.Array:
        gaps = cells.gaps(matrix(vectors))
        nearest = gaps.argmin(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(nearest.astype(np.int32)), pa.array(gaps[np.arange(len(gaps)), nearest])],
            names=_PLACE.names,
        )

    placed = index.where(F.col(vec_col).isNotNull()).withColumn("_place", place(F.col(vec_col)))
    return placed.select(*index.columns, "_place.cell", "_place.cell_distance")


def write_cells(placed: DataFrame, path: str) -> DataFrame:
    """Store a placed index by cell, an over-full cell as several files; the stored table.

    A search then reads only the folders of the cells it probes.
    """
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def cell_radii(placed: DataFrame) -> DataFrame:
    """Rows and radius of each cell; merged before the shuffle, so a full cell is no burden."""
    return placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("cell_distance").alias("radius")
    )


def _probes(queries: DataFrame, cells: Cells, radii: dict[int, float]) -> DataFrame:
    """Add ``probes``, the filled cells, nearest first: array of (cell, order, floor).

    ``floor`` is the least distance any row of the cell can have.
    """
    filled = np.array(sorted(radii), dtype=np.int64)
    reach = np.array([radii[cell] for cell in filled])
    probe = T.ArrayType(T.StructType([
        T.StructField("cell", T.IntegerType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("floor", T.DoubleType()),
    ]))

    @F.arrow_udf(probe)
    def rank_cells(vectors: pa.Array) -> pa.Array:
        gaps = cells.gaps(matrix(vectors))[:, filled]
        floors = np.maximum(gaps - reach, 0.0) ** 2
        orders = gaps.argsort(axis=1, kind="stable")
        rows = pa.StructArray.from_arrays(
            [
                pa.array(filled[orders].ravel().astype(np.int32)),
                pa.array(np.tile(np.arange(len(filled), dtype=np.int32), len(vectors))),
                pa.array(np.take_along_axis(floors, orders, axis=1).ravel()),
            ],
            names=["cell", "order", "floor"],
        )
        ends = np.arange(len(vectors) + 1, dtype=np.int32) * len(filled)
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    # Told to be not deterministic: a filter on the probes, also one that Spark infers, else ranks the cells again in a worker of its own.
    ranked = rank_cells.asNondeterministic()("embedding")
    return queries.where(F.col("embedding").isNotNull()).withColumn("probes", ranked)


def _cells_where(keep: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter("probes", keep), lambda probe: probe["cell"])


def _radii(placed: DataFrame) -> dict[int, float]:
    # One row per cell, MAX_CELLS at most.
    return {row["cell"]: row["radius"] for row in cell_radii(placed).collect()}


def approximate_top_k(
    placed: DataFrame, queries: DataFrame, cells: Cells, nprobe: int = 4, id_col: str = "chunk_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Top-k (squared L2) within the ``nprobe`` nearest cells of each query."""
    probes = _probes(queries, cells, _radii(placed))
    near = probes.withColumn("cell", _cells_where(lambda probe: probe["order"] < nprobe))
    return top_k(placed, near, id_col, vec_col, by="cell")


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> float:
    """Share of the exact hits (query_id, id) that were found."""
    pairs = ["query_id", id_col]
    counted = exact.select(*pairs).join(found.select(*pairs).withColumn("_hit", F.lit(1)), pairs, "left").agg(
        F.count("_hit").alias("hit"), F.count(F.lit(1)).alias("n")).first()
    return counted["hit"] / counted["n"] if counted["n"] else 1.0


def enough_probes(
    placed: DataFrame, queries: DataFrame, cells: Cells, target: float = 0.9, id_col: str = "chunk_id", vec_col: str = "embedding",
    sample: int = 256,
) -> int:
    """The least number of probes, by doubling, that finds ``target`` of the exact hits of a sample of the queries.

    About ``sample`` queries by hash of their id are answered both ways. All filled cells find everything, so there is an answer.
    """
    share = sample / max(queries.count(), 1)
    asked = stored(queries.where(F.pmod(F.xxhash64(F.lit("probes"), "query_id"), F.lit(10**6)) < int(min(1.0, share) * 10**6)), "sample")
    exact = stored(top_k(placed, asked, id_col, vec_col), "exact")
    n_cells, nprobe = len(_radii(placed)), 1
    while nprobe < n_cells and recall(approximate_top_k(placed, asked, cells, nprobe, id_col, vec_col), exact, id_col) < target:
        nprobe *= 2
    return min(nprobe, max(n_cells, 1))


def pruned_top_k(
    placed: DataFrame, queries: DataFrame, cells: Cells, nprobe: int = 1, id_col: str = "chunk_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Exact top-k (squared L2), reading only the cells that can hold a hit.

    The first pass gives each query a bound, the k-th best distance of its nearest cells
    (none when they hold fewer than k rows); the second visits the cells below that bound.
    """
    probes = _probes(queries, cells, _radii(placed))
    near = probes.withColumn("cell", _cells_where(lambda probe: probe["order"] < nprobe))
    bounded = distance_bounds(near, placed, id_col=id_col, vec_col=vec_col, by="cell")
    reach = F.coalesce(F.col("bound") + SLACK, F.lit(float("inf")))
    within = bounded.withColumn("cell", _cells_where(lambda probe: probe["floor"] <= reach))
    return top_k(placed, within, id_col, vec_col, by="cell")
