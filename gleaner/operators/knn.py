"""Exact nearest-neighbour search, for one query and for batches.

Batches are answered without pairing rows: query vectors travel to the index (or, when they
are too many, past blocks of the index), every task multiplies two matrices and
emits at most k rows per query, and a window keeps the k best of those.

Distances are compared at six decimals, ties going to the lower id, so that results do not
depend on how the rows were spread over tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.session import stored

DISTANCE_DECIMALS = 6
SLACK = 10.0**-DISTANCE_DECIMALS

# Query vectors sent to every task: at most 64 MB at 1,024 dimensions.
MAX_BROADCAST_QUERIES = 16_384
# Rows of a block of the index, and of queries compared with it together, at 1,024 dimensions: 64 and 4 MB. A block has more rows of fewer.
INDEX_BLOCK_ROWS = 16_384
QUERY_BLOCK_ROWS = 1_024
BLOCK_DIM = 1_024
# Hits that queries compared together ask for, about: 20 MB while they are sorted.
MAX_HITS = 262_144
# Groups whose places in blocks are known to every task; beyond that each group has blocks of its own.
MAX_GROUPS = 10_000
# Tasks per core that blocks and parts of the queries make together.
TASKS_PER_CORE = 3
# Index rows turned into a matrix at a time (16 MB at 1,024 dimensions), and distances a task holds at a time (2 MB).
INDEX_PIECE_ROWS = 2_048
MAX_DISTANCES = 262_144
# Rows, and queries, of a product in single precision (1 MB), and norms up to which it is used.
SCREEN_ROWS = 512
MAX_NORM = 1e12


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Distance of two arrays in double precision: ``l2sq`` or ``cosine``."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)

    def double(value: Column) -> Column:
        return value.cast("double")

    if metric == "l2sq":
        return total(F.zip_with(a, b, lambda x, y: (double(x) - double(y)) * (double(x) - double(y))))
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: double(x) * double(y)))
        norm_a = F.sqrt(total(F.transform(a, lambda x: double(x) * double(x))))
        norm_b = F.sqrt(total(F.transform(b, lambda x: double(x) * double(x))))
        return F.when((norm_a == 0) | (norm_b == 0), F.lit(1.0)).otherwise(1.0 - dot / (norm_a * norm_b))
    raise ValueError(f"unknown metric {metric!r}")


def nearest(
    index: DataFrame,
    vector: list[float],
    k: int,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    metric: str = "l2sq",
) -> DataFrame:
    """The k rows nearest to one vector, all in the JVM: a scan and a top-k of ids and vectors, no sort.

    The other columns of the k rows, if there are any, come from a second scan that the k ids are broadcast to; ids tell rows apart.
    """
    literal = F.array(*[F.lit(float(value)) for value in vector])
    place = [F.round("distance", DISTANCE_DECIMALS), F.col(id_col)]
    best = (
        index.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
        .withColumn("distance", distance(F.col(vec_col), literal, metric)).drop(vec_col)
        .orderBy(*place).limit(max(k, 0))
    )
    others = [name for name in index.columns if name not in (id_col, vec_col)]
    if not others:
        return best
    # At most k rows are broadcast.
    return index.select(id_col, *others).join(F.broadcast(best), id_col).orderBy(*place)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of equal length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _distances(queries: np.ndarray, rows: np.ndarray, row_norms: np.ndarray, metric: str) -> np.ndarray:
    products = queries @ rows.T
    query_norms = (queries**2).sum(1)
    if metric == "cosine":
        lengths = np.sqrt(query_norms)[:, None] * np.sqrt(row_norms)[None, :]
        return 1.0 - products / np.where(lengths == 0, 1.0, lengths)
    products *= -2.0
    products += query_norms[:, None]
    products += row_norms[None, :]
    return np.maximum(products, 0.0, out=products)


class _Best:
    """The k best (rounded distance, id, distance) seen so far for each query row."""

    def __init__(self, queries: pa.Table):
        self.counts = queries.column("k").to_numpy()
        self.bounds = queries.column("bound").to_numpy().copy()
        self.hits: list[list[tuple]] = [[] for _ in self.counts]

    def offer(self, which: np.ndarray, vectors: np.ndarray, ids: np.ndarray, column: pa.Array | pa.ChunkedArray,
              metric: str) -> None:
        """Show the index rows of ``column`` to the query rows ``which`` of ``vectors``, a piece at a time."""
        for start in range(0, len(ids), INDEX_PIECE_ROWS):
            rows = matrix(column.slice(start, INDEX_PIECE_ROWS))
            norms, own = (rows**2).sum(1), ids[start:start + len(rows)]
            step = max(1, MAX_DISTANCES // len(rows))
            for at in range(0, len(which), step):
                some = which[at:at + step]
                self._offer(some, _distances(vectors[some], rows, norms, metric), own)

    def _offer(self, which: np.ndarray, exact: np.ndarray, ids: np.ndarray) -> None:
        for at in np.flatnonzero(np.isinf(self.bounds[which])):
            k = self.counts[which[at]]
            if len(ids) > k:
                self.bounds[which[at]] = np.partition(exact[at], k - 1)[k - 1]
        near = exact <= (self.bounds[which] + SLACK)[:, None]
        for at in np.flatnonzero(near.any(axis=1)):
            query, places = which[at], np.flatnonzero(near[at])
            found = exact[at, places]
            rounded = np.round(found, DISTANCE_DECIMALS)
            offers = zip(rounded.tolist(), ids[places].tolist(), found.tolist())
            best = heapq.nsmallest(int(self.counts[query]), self.hits[query] + list(offers))
            self.hits[query] = best
            if len(best) == self.counts[query]:
                self.bounds[query] = min(self.bounds[query], best[-1][0])

    def table(self, query_ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
        taken = [at for at, best in enumerate(self.hits) for _ in best]
        flat = [hit for best in self.hits for hit in best]
        columns = [
            query_ids.take(pa.array(taken, pa.int64())),
            pa.array([hit[1] for hit in flat]),
            pa.array([hit[2] for hit in flat], pa.float64()),
            pa.array(self.counts[taken]),
        ]
        return pa.RecordBatch.from_arrays(
            [column.cast(field.type) for column, field in zip(columns, schema)], schema=schema
        )


def _members(group_lists: list[list[str]]) -> dict:
    """Query rows of each group."""
    found: dict = {}
    for at, keys in enumerate(group_lists):
        for key in keys:
            found.setdefault(key, []).append(at)
    return {key: np.array(places) for key, places in found.items()}


def _groups(keys: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """The rows of each group of a batch."""
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for key, (start, end) in zip(coded.dictionary.to_pylist(), pairwise(ends)):
        yield key, order[start:end]


def _search_rows(index: DataFrame, queries: pa.Table, result: T.StructType, schema: pa.Schema,
                 metric: str) -> DataFrame:
    """One scan of ``index``; ``queries`` travel with the tasks."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        query_ids = table.column("query_id").combine_chunks()
        vectors = matrix(table.column("query_vector"))
        best = _Best(table)
        asked = _members(table.column("query_groups").to_pylist())
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for key, places in _groups(batch.column(2)):
                if key in asked:
                    part = batch if len(places) == len(ids) else batch.take(pa.array(places))
                    best.offer(asked[key], vectors, ids[places], part.column(1), metric)
        out = best.table(query_ids, schema)
        if out.num_rows:
            yield out

    return index.mapInArrow(search, result)


class _Block:
    """Index rows that a task holds, by group, to which queries are shown in batches.

    Products in single precision, of which the error is bounded, rule out nearly all pairs; only the others are measured in double
    precision. A pair is ruled out by its ``score``, which falls as the distance grows: product less half the squared norm of
    the row for ``l2sq``, the product of unit vectors for ``cosine``.
    """

    def __init__(self, table: pa.Table, metric: str):
        self.ids, self.column, self.metric = table.column("index_id").chunk(0), table.column("vector").chunk(0), metric
        self.values = self.column.flatten().to_numpy(zero_copy_only=False).reshape(len(self.column), -1)
        size = max(1, MAX_DISTANCES // max(self.values.shape[1], 1))
        self.norms = np.concatenate([np.sqrt((self.values[at:at + size].astype(np.float64)**2).sum(1)) for at in range(0, len(self.values), size)])
        self.regular = bool((self.norms < MAX_NORM).all())  # not so if one is NaN
        self.groups = {key: places[np.argsort(self.norms[places], kind="stable")] for key, places in _groups(table.column("index_group").chunk(0))}
        # Rows of a piece have norms as alike as can be: the greatest bounds the error of all.
        self.reach = np.zeros(len(self.values))
        for places in self.groups.values():
            for at in range(0, len(places), SCREEN_ROWS):
                piece = places[at:at + SCREEN_ROWS]
                self.reach[piece] = self.norms[piece[-1]]
        self._order: np.ndarray | None = None

    @property
    def order(self) -> np.ndarray:
        """The place of each row by its id; no id comes first, as in Spark."""
        if self._order is None:
            self._order = np.empty(len(self.ids), np.int64)
            self._order[pc.array_sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))
        return self._order

    def piece(self, places: np.ndarray) -> np.ndarray:
        """Rows in single precision, with what the score takes off as a last entry."""
        rows = np.zeros((len(places), self.values.shape[1] + 1), np.float32)
        if self.metric == "cosine":
            rows[:, :-1] = self.values[places] / np.where(self.norms[places] == 0, 1.0, self.norms[places])[:, None]
        else:
            rows[:, :-1] = self.values[places]
            rows[:, -1] = self.norms[places]**2 / -2
        return rows

    def hits(self, queries: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
        """The k best rows of each query, and some more that tie with them or nearly so."""
        asked, vectors = _members(queries.column("query_groups").to_pylist()), matrix(queries.column("vector"))
        if not (self.regular and np.isfinite(vectors).all() and (np.abs(vectors) < MAX_NORM / vectors.shape[1]).all()):
            best, ids = _Best(queries), self.ids.to_numpy(zero_copy_only=False)
            for key, places in self.groups.items():
                if key in asked:
                    best.offer(asked[key], vectors, ids[places], self.column.take(pa.array(places)), self.metric)
            return best.table(queries.column("query_id").combine_chunks(), schema)
        near = _Near(self, vectors, queries.column("k").to_numpy(), queries.column("bound").to_numpy())
        for key, places in self.groups.items():
            if key in asked:
                near.offer(asked[key], places)
        which, found, distances = near.best()
        columns = [queries.column("query_id").combine_chunks().take(pa.array(which)), self.ids.take(pa.array(found)),
                   pa.array(distances), pa.array(near.counts[which])]
        return pa.RecordBatch.from_arrays([column.cast(field.type) for column, field in zip(columns, schema)], schema=schema)


def _set(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask of few true values, eight at a time."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64) != 0)
    word, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + bit


class _Near:
    """Rows of a block that can be among the k best of each query of a batch: places of query and row, and score."""

    def __init__(self, block: _Block, vectors: np.ndarray, counts: np.ndarray, bounds: np.ndarray):
        self.block, self.vectors, self.counts, self.bounds = block, vectors, counts.astype(np.int64), bounds
        self.norms = np.sqrt((vectors**2).sum(1))
        self.cosine = block.metric == "cosine"
        self.screen = np.zeros((len(vectors), vectors.shape[1] + 1), np.float32)
        self.screen[:, :-1] = vectors / np.where(self.norms == 0, 1.0, self.norms)[:, None] if self.cosine else vectors
        self.screen[:, -1] = 1.0
        # Scores below these are ruled out. Two distances that are one at six decimals differ by less than SLACK.
        self.slack = SLACK * (1.01 if self.cosine else 0.505)
        self.floors = (1.0 - bounds if self.cosine else (self.norms**2 - bounds) / 2) - self.slack
        self.kept = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.float32))
        self.products, self.near = np.empty(SCREEN_ROWS * SCREEN_ROWS, np.float32), np.empty(SCREEN_ROWS * SCREEN_ROWS, np.bool_)
        self.new: list[tuple] = []
        self.n_new, self.room = 0, max(int(self.counts.sum()), MAX_DISTANCES // 8)

    def _error(self, which: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
        """What a score in single precision may be off: rounding of entries, of their products and of sums in any order."""
        unit = 1.1 * 2.0**-24 * (self.vectors.shape[1] + 8)
        return unit * (1.0 if self.cosine else self.norms[which] * reach + reach**2 / 2) + 1e-30

    def offer(self, which: np.ndarray, places: np.ndarray) -> None:
        """Show rows to some of the queries, a product of bounded size at a time."""
        for start in range(0, len(places), SCREEN_ROWS):
            own = places[start:start + SCREEN_ROWS]
            rows = self.block.piece(own).T
            for at in range(0, len(which), SCREEN_ROWS):
                some = which[at:at + SCREEN_ROWS]
                shape = len(some), len(own)
                scores, near = (buffer[:len(some) * len(own)].reshape(shape) for buffer in (self.products, self.near))
                np.matmul(self.screen[some], rows, out=scores)
                error = self._error(some, self.block.reach[own[0]])
                most = int(self.counts[some].max())
                fresh = np.flatnonzero(np.isneginf(self.floors[some]))
                if len(fresh) and most <= len(own):
                    kth = np.partition(scores[fresh], len(own) - most, axis=1)[:, len(own) - most]
                    self.floors[some[fresh]] = kth - error[fresh] - self.slack if not self.cosine else kth - error - self.slack
                least = np.nextafter((self.floors[some] - error).astype(np.float32), np.float32(-np.inf))
                flat = _set(np.greater_equal(scores, least[:, None], out=near))
                if len(flat):
                    at_query, at_row = np.divmod(flat, len(own))
                    self.new.append((some[at_query].astype(np.int32), own[at_row], scores.reshape(-1)[flat]))
                    self.n_new += len(flat)
                    if self.n_new > self.room:
                        self._tighten()

    def _tighten(self) -> None:
        """Raise the floors to the k best scores so far and drop what is below; ties of more rows than k are cut by id."""
        which, places, scores = (np.concatenate(parts) for parts in zip(self.kept, *self.new))
        self.new, self.n_new = [], 0
        low = (scores - self._error(which, self.block.reach[places])).astype(np.float64)
        bits = low.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))  # the greater, the lower
        order = np.argsort((which.astype(np.uint64) << np.uint64(32)) | bits.astype(np.uint64))
        which, places, scores, low = which[order], places[order], scores[order], low[order]
        sizes = np.bincount(which, minlength=len(self.counts))
        full = np.flatnonzero(sizes >= self.counts)
        kth = (np.cumsum(sizes) - sizes + self.counts - 1)[full]
        # The order was taken in single precision: the next lower number bounds the k-th.
        least = np.nextafter(low[kth].astype(np.float32), np.float32(-np.inf)).astype(np.float64)
        self.floors[full] = np.maximum(self.floors[full], least - self.slack)
        keep = scores + self._error(which, self.block.reach[places]) >= self.floors[which]
        self.kept = which[keep], places[keep], scores[keep]
        if len(self.kept[0]) > 2 * self.room:
            self._cut()

    def _cut(self) -> np.ndarray:
        """Keep the k best of each query by rounded distance and id; their distances."""
        which, places, scores = self.kept
        distances = self._distances(which, places)
        rounded = np.round(distances, DISTANCE_DECIMALS)
        order = np.lexsort((self.block.order[places], rounded, which))
        sizes = np.bincount(which, minlength=len(self.counts))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = order[rank < self.counts[which[order]]]
        self.kept = which[order], places[order], scores[order]
        return distances[order]

    def _distances(self, which: np.ndarray, places: np.ndarray) -> np.ndarray:
        found = np.empty(len(which))
        size = max(1, MAX_DISTANCES // self.vectors.shape[1])
        for at in range(0, len(which), size):
            asked, rows = self.vectors[which[at:at + size]], self.block.values[places[at:at + size]].astype(np.float64)
            if self.cosine:
                lengths = self.norms[which[at:at + size]] * self.block.norms[places[at:at + size]]
                found[at:at + size] = 1.0 - np.einsum("ij,ij->i", asked, rows) / np.where(lengths == 0, 1.0, lengths)
            else:
                found[at:at + size] = ((asked - rows)**2).sum(1)
        return found

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and distance of what is left."""
        if self.new:
            self._tighten()
        distances = self._cut() if len(self.kept[0]) > 1.5 * self.counts.sum() else self._distances(*self.kept[:2])
        within = distances <= self.bounds[self.kept[0]] + SLACK
        return self.kept[0][within], self.kept[1][within], distances[within]


def _packed(groups: list[str], sizes: list[int], limit: int) -> dict[str, tuple[int, int]]:
    """The first block of each group, and in how many it is: small groups share a block of at most ``limit`` rows."""
    places, last, room = {}, -1, 0
    for size, group in sorted(zip(sizes, groups)):
        if size > room:
            last, room = last + 1, limit
        blocks = max(1, -(-size // limit))
        places[group] = last, blocks
        last, room = (last + blocks - 1, 0) if blocks > 1 else (last, room - size)
    return places


def _routed(places: dict[str, tuple[int, int]]):
    """The blocks that hold the groups of a query, each with those groups."""

    @F.arrow_udf("array<struct<block:int,query_groups:array<string>>>")
    def route(column: pa.Array) -> pa.Array:
        found = []
        for keys in column.to_pylist():
            own: dict[int, list[str]] = {}
            for key in keys or ():
                first, blocks = places.get(key, (0, 0))
                for block in range(first, first + blocks):
                    own.setdefault(block, []).append(key)
            found.append([{"block": block, "query_groups": members} for block, members in own.items()])
        return pa.array(found, pa.list_(pa.struct([("block", pa.int32()), ("query_groups", pa.list_(pa.string()))])))

    return route.asNondeterministic()  # else a filter that Spark infers routes again in a worker of its own


def _search_blocks(index: DataFrame, queries: DataFrame, result: T.StructType, schema: pa.Schema,
                   metric: str, many: bool, whole: bool) -> DataFrame:
    """Queries to blocks of the index, for query sets too large to travel.

    The index is cut into blocks of bounded size, a large group into several by hash, small groups together into one. A query goes once to
    each block that has rows of its groups. Where blocks are fewer than the cores can take (and the queries are ``many``),
    the queries are cut as well, and each part meets a copy of the block: rows are copied as often as tasks ask for, not as queries do.
    In a task a block comes first and is held, its queries stream past it and leave little more than k rows each.
    """
    spark = index.sparkSession
    counted = index.where(F.col("index_group").isNotNull()).groupBy(F.col("index_group").alias("block_group")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("index_vector")).alias("dim"))
    sizes = counted.limit(MAX_GROUPS + 1).toArrow()
    if not sizes.num_rows:
        return spark.createDataFrame([], result)
    limit = max(1, INDEX_BLOCK_ROWS * BLOCK_DIM // max(pc.max(sizes.column("dim")).as_py(), 1))
    same, number = F.col("block_group") == F.col("index_group"), F.pmod(F.xxhash64("index_id"), F.col("blocks")).cast("int")
    if sizes.num_rows <= MAX_GROUPS:
        names = sizes.column("block_group").to_pylist()
        places = _packed(names, sizes.column("n_rows").to_pylist(), limit)
        n_blocks = 1 + max(first + blocks - 1 for first, blocks in places.values())
        parts = max(1, TASKS_PER_CORE * spark.sparkContext.defaultParallelism // n_blocks) if many else 1
        layout = F.broadcast(spark.createDataFrame(pa.table({
            "block_group": names, "first": pa.array([places[name][0] for name in names], pa.int32()),
            "blocks": pa.array([places[name][1] for name in names], pa.int32())})))
        bin_of, number = F.lit(""), F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(parts - 1)), lambda part: (F.col("first") + number) * parts + part))
        if whole:
            asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        else:
            asked = queries.withColumn("_routes", _routed(places)("query_groups")).withColumn("_route", F.explode("_routes")).drop(
                "query_groups", "_routes").select("*", "_route.block", "_route.query_groups").drop("_route")
        asked = asked.withColumn("block", F.col("block") * parts + F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("bin", bin_of)
    else:
        layout = counted.select("block_group", F.ceil(F.col("n_rows") / F.lit(float(limit))).cast("int").alias("blocks"))
        bin_of = F.col("index_group")
        asked = queries.withColumn("query_group", F.explode("query_groups")).join(layout, F.col("block_group") == F.col("query_group")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query_groups", F.array("query_group")).withColumn("bin", F.col("query_group"))
    rows = index.join(layout, same).select(
        bin_of.alias("bin"), number.alias("block"), F.lit(0).alias("side"), F.col("index_vector").alias("vector"), "index_id", "index_group", *[
            F.lit(None).cast(queries.schema[name].dataType).alias(name) for name in ("query_groups", "query_id", "k", "bound")])
    asked = asked.select(
        "bin", "block", F.lit(1).alias("side"), F.col("query_vector").alias("vector"),
        *[F.lit(None).cast(index.schema[name].dataType).alias(name) for name in ("index_id", "index_group")],
        "query_groups", "query_id", "k", "bound")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[pa.RecordBatch] = []
        block: _Block | None = None
        for batch in batches:
            keys = list(zip(batch.column("bin").to_pylist(), batch.column("block").to_pylist(), batch.column("side").to_pylist()))
            edges = [0, *[at for at in range(1, len(keys)) if keys[at] != keys[at - 1]], len(keys)]
            for start, end in pairwise(edges):
                key, part = keys[start], batch.slice(start, end - start)
                if held is None or key[:2] != held[:2]:
                    parts, block = [], None
                held = key
                if key[2] == 0:
                    parts.append(part.select(["index_id", "index_group", "vector"]))
                elif parts or block:
                    if block is None:
                        table, parts = pa.Table.from_batches(parts).combine_chunks(), []
                        block = _Block(table, metric)
                        del table
                        pa.default_memory_pool().release_unused()
                    step = max(1, min(QUERY_BLOCK_ROWS, MAX_HITS // pc.max(part.column("k")).as_py()))
                    for at in range(0, part.num_rows, step):
                        out = block.hits(pa.Table.from_batches([part.slice(at, step)]), schema)
                        if out.num_rows:
                            yield out

    both, place = rows.unionByName(asked), ["bin", "block"]
    spread = both.repartitionById(n_blocks * parts, F.col("block")) if sizes.num_rows <= MAX_GROUPS else both.repartition(*place)
    return spread.sortWithinPartitions(*place, "side").mapInArrow(search, result)


def top_k(
    index: DataFrame,
    queries: DataFrame,
    id_col: str = "chunk_id",
    vec_col: str = "embedding",
    by: str | None = None,
    metric: str = "l2sq",
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """The ``k`` nearest index rows of every query: query_id, id, distance, rank.

    ``queries`` has query_id, embedding, k and, with ``by``, that column: a query then sees
    only the index rows of its group, or of its groups if that column is an array. Groups
    are compared as text. A column ``bound`` in
    ``queries`` gives a distance that the k-th hit is known not to exceed (see
    ``distance_bounds``): tasks then emit only what can still be a hit.
    """
    group = F.lit("") if by is None else F.col(by).cast("string")
    if by is None:
        groups = F.array(F.lit(""))
    elif isinstance(queries.schema[by].dataType, T.ArrayType):
        groups = F.col(by).cast("array<string>")
    else:
        groups = F.array(group)
    rows = index.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("index_id"), F.col(vec_col).alias("index_vector"), group.alias("index_group")
    )
    unbounded = F.lit(float("inf"))
    bound = F.coalesce("bound", unbounded) if "bound" in queries.columns else unbounded
    asked = queries.where(F.col("embedding").isNotNull() & (F.col("k") > 0)).select(
        "query_id", F.col("embedding").alias("query_vector"), F.col("k").cast("int").alias("k"),
        groups.alias("query_groups"), bound.alias("bound"),
    )
    result = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType),
        T.StructField(id_col, rows.schema["index_id"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("k", T.IntegerType()),
    ])
    # Only this many rows can reach the driver; one more tells that there are others.
    probe = asked.limit(max(max_broadcast, QUERY_BLOCK_ROWS) + 1).toArrow()
    schema = to_arrow_schema(result)
    best = Window.partitionBy("query_id").orderBy(F.round("distance", DISTANCE_DECIMALS), id_col)
    rank = F.row_number().over(best)
    if probe.num_rows > max_broadcast:
        many = probe.num_rows > QUERY_BLOCK_ROWS
        ranked = _search_blocks(rows, asked, result, schema, metric, many, by is None).withColumn("rank", rank)
    else:
        wanted = pc.unique(pc.list_flatten(probe.column("query_groups"))).to_pylist()
        if by is not None:
            rows = rows.where(F.col("index_group").isin(wanted))
        most = pc.max(probe.column("k")).as_py() or 0
        ranked = (
            _search_rows(rows, probe, result, schema, metric)
            .withColumn("rank", rank).where(F.col("rank") <= most)
        )
    return ranked.where("rank <= k").drop("k")


def distance_bounds(queries: DataFrame, part: DataFrame, **options) -> DataFrame:
    """``queries`` with a ``bound``, taken from the hits in ``part`` of the index.

    The k-th best distance within any part of an index is never less than that within the
    whole. Read first, a sixteenth of an index of many files leaves about sixteen times k
    candidates of each query to be shuffled, in place of k from every task.
    """
    hits = top_k(part, queries, **options)
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.max(F.round("distance", DISTANCE_DECIMALS)).alias("bound"),
    )
    joined = queries.drop("bound").join(stored(found, "bounds"), "query_id", "left")
    return joined.withColumn("bound", F.when(F.col("found") >= F.col("k"), F.col("bound"))).drop("found")
