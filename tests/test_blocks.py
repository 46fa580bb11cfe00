"""Searches of many queries: blocks are as large as memory allows, few pairs are measured, and hits are those of brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import knn
from gleaner.operators.knn import top_k

DIM = 8


@pytest.fixture
def searches(monkeypatch, spark):
    """What goes into each search of blocks, and what comes out."""
    seen = []
    frame = type(spark.range(1))
    whole = frame.mapInArrow

    def spy(self, *args):
        out = whole(self, *args)
        seen.append((self, out))
        return out

    monkeypatch.setattr(frame, "mapInArrow", spy)
    return seen


def table(spark):
    """Copies, more than any k; long and short vectors; a zero; groups of all sizes."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, DIM)).astype(np.float32)
    vectors[300:700] = vectors[7]
    vectors[800:850] *= 1000
    vectors[900] = 0
    ids, groups = rng.permutation(1500), np.minimum(rng.geometric(0.2, 1500), 12)
    asked = np.concatenate([vectors[[7, 0, 800, 900]], rng.normal(size=(60, DIM)).astype(np.float32)])
    rows = [(int(i), v.tolist(), int(g)) for i, v, g in zip(ids, vectors, groups)] + [(9999, None, 1)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp int").repartition(3)
    queries = spark.createDataFrame([(at, v.tolist(), (at * 7) % 90, [at % 12, at % 5, 99] if at % 12 != at % 5 else [at % 12]) for at, v in enumerate(asked)],
                                    "query_id long, embedding array<float>, k int, grp array<int>")
    return index, queries, ids, vectors, groups, asked


def brute(ids, vectors, groups, asked, by, metric):
    found = {}
    for at, query in enumerate(asked.astype(float)):
        rows = vectors.astype(float)
        if metric == "l2sq":
            gaps = ((rows - query)**2).sum(1)
        else:
            lengths = np.linalg.norm(rows, axis=1) * np.linalg.norm(query)
            gaps = 1 - rows @ query / np.where(lengths == 0, 1, lengths)
        inside = np.isin(groups, [at % 12, at % 5]) if by else np.ones(len(ids), bool)
        order = np.lexsort((ids, np.round(gaps, 6)))
        best = order[inside[order]][:(at * 7) % 90]
        found.update({(at, rank): (int(ids[place]), gaps[place]) for rank, place in enumerate(best, 1)})
    return found


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("by", [None, "grp"])
@pytest.mark.parametrize("batch, groups", [(1000, 10_000), (5, 10_000), (1000, 2)])
def test_blocks_find_what_brute_force_finds(spark, monkeypatch, metric, by, batch, groups):
    for name, value in {"INDEX_BLOCK_ROWS": 2, "SCREEN_ROWS": 32, "MAX_DISTANCES": 512, "QUERY_BLOCK_ROWS": batch, "MAX_GROUPS": groups}.items():
        monkeypatch.setattr(knn, name, value)
    index, queries, *data = table(spark)
    got = {(row.query_id, row["rank"]): (row.vec_id, row.distance) for row in top_k(index, queries, "vec_id", by=by, metric=metric, max_broadcast=0).collect()}
    want = brute(*data, by, metric)
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], rel=1e-9, abs=1e-9) for key in want)


def test_a_query_meets_few_blocks_and_leaves_few_hits(spark, searches, monkeypatch):
    """Short vectors: more of them are held at once, in as much memory, so queries are copied and hits left less often."""
    monkeypatch.setattr(knn, "INDEX_BLOCK_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(at, rng.normal(size=DIM).astype(np.float32).tolist()) for at in range(900)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = index.where("vec_id < 50").selectExpr("vec_id AS query_id", "embedding", "5 AS k")
    assert top_k(index, queries, "vec_id", max_broadcast=0).count() == 250
    given, left = searches[-1]
    assert given.where("side = 1").count() == 2 * 50  # 512 rows to a block
    assert left.count() == 2 * 250


def test_queries_are_cut_where_blocks_are_few(spark, searches, monkeypatch):
    """One block keeps one core busy: parts of the queries meet copies of it."""
    monkeypatch.setattr(knn, "QUERY_BLOCK_ROWS", 20)
    rng = np.random.default_rng(2)
    rows = [(at, rng.normal(size=DIM).astype(np.float32).tolist()) for at in range(400)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = index.selectExpr("vec_id AS query_id", "embedding", "3 AS k")
    hits = top_k(index, queries, "vec_id", max_broadcast=0)
    tasks = knn.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    given, left = searches[-1]
    assert given.where("side = 0").count() == 400 * tasks
    assert given.where("side = 1").count() == 400 and left.count() == 1200
    assert given.groupBy(F.spark_partition_id()).count().count() == tasks
    assert {(row.query_id, row.vec_id) for row in hits.where("rank = 1").collect()} == {(at, at) for at in range(400)}


def test_few_pairs_are_measured_in_double_precision(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, DIM)).astype(np.float32)
    measured = []
    whole = knn._Near._distances
    monkeypatch.setattr(knn._Near, "_distances", lambda self, which, places: (measured.append(len(which)), whole(self, which, places))[1])
    column = pa.array(vectors.tolist(), pa.list_(pa.float32()))
    block = knn._Block(pa.table({"index_id": pa.array(range(3000)), "index_group": pa.array([""] * 3000), "vector": column}), "l2sq")
    asked = pa.table({"query_id": pa.array(range(40)), "vector": column.slice(0, 40), "query_groups": pa.array([[""]] * 40),
                      "k": pa.array([5] * 40, pa.int32()), "bound": pa.array([np.inf] * 40)})
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64()), ("k", pa.int32())])
    hits = block.hits(asked, schema)
    gaps = ((vectors[:40, None].astype(float) - vectors[None])**2).sum(axis=2)
    want = {(at, int(place)) for at in range(40) for place in np.argsort(gaps[at], kind="stable")[:5]}
    assert want == {(row["query_id"], row["vec_id"]) for row in hits.to_pylist()}
    assert sum(measured) <= 2 * 200


@pytest.mark.parametrize("odd", [np.nan, np.inf, 1e30])
def test_vectors_beyond_single_precision_are_measured_as_before(odd):
    vectors = np.arange(40, dtype=np.float64).reshape(20, 2)
    vectors[4] = odd
    column = pa.array(vectors.tolist(), pa.list_(pa.float64()))
    block = knn._Block(pa.table({"index_id": pa.array(range(20)), "index_group": pa.array(["g"] * 20), "vector": column}), "l2sq")
    asked = pa.table({"query_id": pa.array([0, 1]), "vector": column.slice(0, 2), "query_groups": pa.array([["g"], ["g", "h"]]),
                      "k": pa.array([3, 2], pa.int32()), "bound": pa.array([np.inf] * 2)})
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64()), ("k", pa.int32())])
    assert [(row["query_id"], row["vec_id"], row["distance"]) for row in block.hits(asked, schema).to_pylist()] == [
        (0, 0, 0), (0, 1, 8), (0, 2, 32), (1, 1, 0), (1, 0, 8)]


def test_small_groups_share_a_block(spark, searches, monkeypatch):
    """A query of many cells goes once to the block that holds them, not once to each cell."""
    rng = np.random.default_rng(2)
    rows = [(at, rng.normal(size=DIM).astype(np.float32).tolist(), f"g{at % 16}") for at in range(800)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")
    queries = index.where("vec_id < 30").select("embedding", F.col("vec_id").alias("query_id"), F.lit(5).alias("k"), F.array(
        *[F.lit(f"g{at}") for at in range(12)]).alias("cell"))
    hits = top_k(index, queries, "vec_id", by="cell", max_broadcast=0)
    given, left = searches[-1]
    assert given.where("side = 1").count() == 30 and left.count() == 150
    assert hits.where("vec_id % 16 >= 12").count() == 0 and hits.count() == 150
    assert knn._packed(["a", "b", "c", "d"], [3, 25, 4, 5], 10) == {"a": (0, 1), "c": (0, 1), "d": (1, 1), "b": (2, 3)}
