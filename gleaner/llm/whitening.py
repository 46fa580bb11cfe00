"""Embedding whitening: covariance of distinct vectors with their multiplicities, each whitened once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import ship_package, stored

SHIFT = 1_000_000
LARGEST = float(2**62)  # scaled entries beyond it are no long numbers
HOT_SHARE = 1_000  # a vector with this part of all rows is joined by broadcast; there are at most so many
BLOCK_ENTRIES = 1 << 20  # entries multiplied at a time
FLAT = 1e-12  # eigenvalues below this part of the largest are no directions


def entries_of(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry, as long; missing for a vector that is missing, or holds an entry that is
    missing, not finite, or (beyond 2^62) without a long number."""
    scaled = F.transform(vector, lambda c: 64 * c.cast("double"))
    usable = F.forall(scaled, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))  # false for NaN, which is above all
    return F.when(vector.isNotNull() & F.coalesce(usable, F.lit(False)),
                  F.transform(scaled, lambda c: F.floor(c).cast("long") + SHIFT))


def distinct_vectors(rows: DataFrame, vec_col: str = "x") -> DataFrame:
    """Each distinct vector with its number of rows, counted before the shuffle: a vector may repeat in any share of them."""
    return rows.groupBy(F.col(vec_col).alias("x")).agg(F.count(F.lit(1)).alias("n_rows"))


@dataclass(frozen=True)
class Whitening:
    """Exact sums of the fitted vectors, and the directions of their covariance by falling variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues
    vectors: np.ndarray  # a row per component
    trace: float

    @property
    def wide(self) -> np.ndarray:
        """Components that have any variance."""
        return self.values > FLAT * max(self.values, default=0.0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n as exact quotients, and the sums over entries of (n*x - S)^2 as Python numbers."""
        sums = np.array(self.sums, object)
        reach = max((abs(int(bound)) for bound in (x.min(initial=0), x.max(initial=0))), default=0)
        if (reach + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1) * self.n * 2 < 2**62:
            gaps = x * self.n - sums.astype(np.int64)
        else:
            gaps = x.astype(object) * self.n - sums
        largest = max((abs(int(bound)) for bound in (gaps.min(initial=0), gaps.max(initial=0))), default=0)
        if largest**2 * max(x.shape[1], 1) < 2**63:
            square = (gaps.astype(np.int64) ** 2).sum(axis=1).tolist()
        else:
            square = [sum(int(gap) ** 2 for gap in row) for row in gaps]
        return gaps.astype(np.float64) / self.n, square

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the root of the variance; not a number for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.wide, centred @ self.vectors.T / np.sqrt(self.values), np.nan)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _weights(batch: pa.RecordBatch, counted: bool) -> np.ndarray:
    return batch.column(1).to_numpy().astype(np.int64) if counted else np.ones(batch.num_rows, np.int64)


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_ENTRIES // max(dim, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def vector_sums(vectors: DataFrame, dim: int, counted: bool) -> tuple[int, tuple[int, ...]]:
    """Number and exact sums of the fitted vectors; a row per task and entry is added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = [0] * dim, 0
        for batch in batches:
            for block in _blocks(batch, dim):
                x, weight = _matrix(block.column(0), dim), _weights(block, counted)
                number += int(weight.sum())
                # Halves of 32 bits add up without overflow, whatever the entries; weighted ones as Python numbers.
                halves = [x & 0xFFFFFFFF, x >> 32]
                if counted:
                    halves = [half.astype(object) * weight[:, None] for half in halves]
                low, high = (half.sum(axis=0) for half in halves)
                total = [old + int(a) + (int(b) << 32) for old, a, b in zip(total, low, high)]
        if number:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, dim), pa.int32()), pa.array([str(value) for value in (number, *total)])], names=["entry", "total"])

    sums = vectors.select("x", "n_rows").mapInArrow(add, "entry int, total string").groupBy("entry").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {row["entry"]: int(row["total"]) for row in sums.collect()}  # dim + 1 rows
    return found.get(-1, 0), tuple(found.get(at, 0) for at in range(dim))


def covariance(vectors: DataFrame, fitted: Whitening, counted: bool, white: bool = False) -> np.ndarray:
    """Weighted covariance about the mean, divisor n: centred blocks are multiplied in the tasks, a row per entry of the matrix is added up.

    With ``white`` it is that of the whitened vectors, of components with variance.
    """
    dim = len(fitted.sums)
    size = int(fitted.wide.sum()) if white else dim

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size)), False
        for batch in batches:
            any_rows |= batch.num_rows > 0
            for block in _blocks(batch, dim):
                rows = fitted.centred(_matrix(block.column(0), dim))[0]
                if white:
                    rows = fitted.whitened(rows)[:, fitted.wide]
                total += (rows * _weights(block, counted)[:, None]).T @ rows
        line, entry = np.divmod(np.arange(size * size, dtype=np.int32), max(size, 1))
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(entry), pa.array(total.ravel())], names=["line", "entry", "total"])

    sums = vectors.select("x", "n_rows").mapInArrow(multiply, "line int, entry int, total double").groupBy("line", "entry").agg(
        F.sum("total").alias("total")).toArrow()  # size^2 rows
    matrix = np.zeros((size, size))
    matrix[sums.column("line").to_numpy(), sums.column("entry").to_numpy()] = sums.column("total").to_numpy()
    return matrix / max(fitted.n, 1)


def fit_whitening(vectors: DataFrame, dim: int, components: int, weights: str = "one") -> Whitening:
    """Fit on distinct vectors (x array<long>, n_rows): each counts once (``one``) or as often as it occurs (``count``)."""
    if weights not in ("one", "count"):
        raise ValueError(f"unknown weights {weights!r}")
    counted = weights == "count"
    n, sums = vector_sums(vectors, dim, counted)
    plain = Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0)
    matrix = covariance(vectors, plain, counted)
    values, directions = np.linalg.eigh((matrix + matrix.T) / 2)
    values, directions = np.maximum(values[::-1], 0.0), directions.T[::-1]
    # Either sign would do; the largest entry is made positive.
    ahead = directions[np.arange(dim), np.abs(directions).argmax(axis=1)] if dim else np.ones(0)
    directions = directions * np.where(ahead < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums, values[:components], directions[:components], float(np.trace(matrix)))


def whitened_vectors(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """Distinct vectors with ``deviation`` (exact, decimal) and ``white``, the whitened components."""
    schema = "x array<long>, n_rows long, deviation string, white array<double>"
    dim = len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, dim):
                centred, square = fitted.centred(_matrix(block.column(0), dim))
                white = fitted.whitened(centred)
                ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
                values = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), block.column(1), pa.array([str(value) for value in square]),
                     pa.ListArray.from_arrays(pa.array(ends), values)], names=["x", "n_rows", "deviation", "white"])

    return vectors.select("x", "n_rows").mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def _joined(rows: DataFrame, told: DataFrame, n_rows: int) -> DataFrame:
    """Rows with what is told of their vector. Vectors with a thousandth of all rows, of which there are a thousand at most, are
    broadcast, so that no task gets all rows of one vector; the others meet by their value."""
    hot = F.col("n_rows") * HOT_SHARE >= n_rows
    frequent = F.broadcast(told.where(hot).select("x", "deviation", "white"))
    others = rows.join(F.broadcast(told.where(hot).select("x")), "x", "left_anti")
    return rows.join(frequent, "x").unionByName(others.join(told.where(~hot).select("x", "deviation", "white"), "x"))


def whiten(
    embeddings: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error, n_rows of the vector.

    Vectors that are missing or hold an entry that is missing or not finite take no part, nor do entries whose scaled value has no
    long number. Equal vectors, repeated rows and missing ids are kept: a vector is fitted and whitened once and joined to all its
    rows. Vectors of each length are whitened by themselves, by one fit each; a vector without entries has no components. A component without
    variance (below 1e-12 of the largest; all if only one distinct vector is left) has no whitened value, and
    ``identity_error`` leaves it out; ``explained`` is missing if there is no variance at all. A deviation beyond a long number is
    missing and found in ``exact_deviation``. Other columns are left out.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = stored(embeddings.select(F.col(id_col).alias("vec_id"), entries_of(F.col(vec_col)).alias("x")).where(
        F.col("x").isNotNull()), "vectors")
    distinct = stored(distinct_vectors(rows).withColumn("size", F.size("x")), "distinct")
    sizes = distinct.groupBy("size").agg(F.sum("n_rows").alias("n_rows")).where("size > 0").collect()  # a row per length of vectors
    parts = []
    for size, n_rows in sorted(map(tuple, sizes)):
        own = distinct.where(F.col("size") == size)
        fitted = fit_whitening(own, size, components, weights)
        told = stored(whitened_vectors(own, fitted), "whitened")
        wide = fitted.wide
        error = float(np.abs(covariance(own, fitted, weights == "count", white=True) - np.eye(int(wide.sum()))).max()) if wide.any() else None
        explained = [F.lit(float(value / fitted.trace) if fitted.trace > 0 else None).cast("double") for value in fitted.values]
        joined = _joined(rows.where(F.size("x") == size), told, n_rows)
        parts.append(joined.select(
            "vec_id", F.posexplode("white").alias("at", "whitened"), "deviation").select(
            "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"),
            F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
            F.element_at(F.array(*explained), F.col("at") + 1).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"), F.col("deviation").alias("exact_deviation")))
    if not parts:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                         "identity_error double, exact_deviation decimal(38,0)")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
