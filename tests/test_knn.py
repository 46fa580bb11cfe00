"""Nearest-neighbour plans against brute force, with ties, copies and full groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators.cells import (
    approximate_top_k, assign_cells, cell_radii, enough_probes, pruned_top_k, write_cells,
)
from gleaner.operators.codes import coded_top_k, encode, fit_codebooks
from gleaner.operators.knn import distance, distance_bounds, nearest, top_k
from gleaner.operators.mllib import fit_cells
from gleaner.session import stored

DIM = 8


@pytest.fixture(scope="module")
def data():
    """400 vectors: a third are copies of one, and one group holds half of all rows."""
    random = np.random.default_rng(3)
    vectors = random.normal(size=(400, DIM)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True).astype(np.float32)
    vectors[100:233] = vectors[7]
    ids = random.permutation(400)
    groups = np.where(np.arange(400) < 200, 0, np.arange(400) % 5)
    queries = np.concatenate([vectors[[7, 0, 1, 2]], random.normal(size=(26, DIM)).astype(np.float32)])
    return ids, vectors, groups, queries


@pytest.fixture(scope="module")
def index(spark, data):
    ids, vectors, groups, _ = data
    rows = [(f"c{i:03d}", v.tolist(), int(g)) for i, v, g in zip(ids, vectors, groups)]
    frame = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, grp int").repartition(7)
    none = spark.createDataFrame([("none", None, 0)], frame.schema)
    return frame.union(none).cache()


@pytest.fixture(scope="module")
def queries(spark, data):
    rows = [(i, v.tolist(), (i * 3) % 25 - 1, i % 6) for i, v in enumerate(data[3])]
    return spark.createDataFrame(rows, "query_id long, embedding array<float>, k int, grp int")


def brute(data, by=False, metric="l2sq"):
    ids, vectors, groups, queries = data
    got = {}
    for i, query in enumerate(queries.astype(float)):
        v = vectors.astype(float)
        if metric == "l2sq":
            d = ((v - query) ** 2).sum(1)
        else:
            d = 1 - v @ query / np.linalg.norm(v, axis=1) / np.linalg.norm(query)
        hits = sorted(
            (round(float(x), 6), f"c{c:03d}") for x, c, g in zip(d, ids, groups) if not by or g == i % 6)
        for rank, (x, c) in enumerate(hits[:max((i * 3) % 25 - 1, 0)], 1):
            got[i, rank] = (c, x)
    return got


def rows(hits):
    return {(r.query_id, r["rank"]): (r.chunk_id, round(r.distance, 6) + 0.0) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("limit", [1000, 5])
@pytest.mark.parametrize("by", [None, "grp"])
def test_top_k(data, index, queries, metric, limit, by, monkeypatch):
    from gleaner.operators import knn

    monkeypatch.setattr(knn, "INDEX_BLOCK_ROWS", 37)
    monkeypatch.setattr(knn, "QUERY_BLOCK_ROWS", 6)
    got = rows(top_k(index, queries, by=by, metric=metric, max_broadcast=limit))
    want = brute(data, by is not None, metric)
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and abs(got[key][1] - want[key][1]) < 2e-6 for key in want)


def test_bounds_keep_every_hit(data, index, queries):
    part = index.where("chunk_id < 'c080'")
    for by in (None, "grp"):
        bounded = distance_bounds(queries, part, by=by)
        assert bounded.where("bound is not null").count() > 0
        for limit in (1000, 5):
            assert rows(top_k(index, bounded, by=by, max_broadcast=limit)) == rows(top_k(index, queries, by=by))


def test_hits_do_not_depend_on_partitions(index, queries):
    expected = rows(top_k(index, queries))
    assert rows(top_k(index.repartition(23), queries)) == expected
    assert rows(top_k(index.coalesce(1).orderBy(F.desc("chunk_id")), queries)) == expected


def test_no_queries_or_no_rows(index, queries):
    assert top_k(index, queries.where("false")).count() == 0
    assert top_k(index.where("false"), queries).count() == 0
    assert top_k(index, queries.withColumn("k", F.lit(0))).count() == 0


def test_nearest(data, index):
    ids, vectors, _, queries = data
    got = [(r.chunk_id, round(r.distance, 6)) for r in nearest(index, queries[5].tolist(), 12).collect()]
    d = ((vectors.astype(float) - queries[5].astype(float)) ** 2).sum(1)
    want = sorted((round(float(x), 6), f"c{c:03d}") for x, c in zip(d, ids))[:12]
    assert got == [(c, x) for x, c in want]
    plan = nearest(index, queries[5].tolist(), 12)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("a, b, l2sq, cosine", [
    ([1.0, 0.0], [1.0, 0.0], 0.0, 0.0), ([1.0, 0.0], [0.0, 1.0], 2.0, 1.0), ([1.0, 0.0], [-1.0, 0.0], 4.0, 2.0),
    ([0.0, 0.0], [1.0, 0.0], 1.0, 1.0),
])
def test_distance(spark, a, b, l2sq, cosine):
    pair = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    row = pair.select(
        distance(F.col("a"), F.col("b")).alias("l2sq"), distance(F.col("a"), F.col("b"), "cosine").alias("cosine")
    ).first()
    assert (row.l2sq, row.cosine) == (l2sq, cosine)


def test_plans_pair_no_rows(index, queries):
    for limit in (1000, 5):
        plan = top_k(index, queries, by="grp", max_broadcast=limit)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cells(data, index, queries, tmp_path):
    cells = fit_cells(index, 12)
    placed = write_cells(assign_cells(index, cells), str(tmp_path / "cells"))
    assert placed.count() == 400
    assert cell_radii(placed).agg(F.sum("n_rows")).first()[0] == 400
    exact = brute(data)
    for nprobe in (1, 3):
        assert {k: v[0] for k, v in rows(pruned_top_k(placed, queries, cells, nprobe)).items()} == {
            k: v[0] for k, v in exact.items()}
    pairs = {(q, hit[0]) for (q, _), hit in exact.items()}
    recalls = []
    for nprobe in (1, 4, 12):
        hits = rows(approximate_top_k(placed, queries, cells, nprobe))
        recalls.append(len(pairs & {(q, hit[0]) for (q, _), hit in hits.items()}) / len(pairs))
    assert recalls == sorted(recalls) and recalls[0] > 0.2 and recalls[-1] == 1.0


def test_enough_probes_reach_their_recall(data, index, queries, tmp_path):
    cells = fit_cells(index, 12)
    placed = write_cells(assign_cells(index, cells), str(tmp_path / "cells"))
    pairs = {(q, hit[0]) for (q, _), hit in brute(data).items()}
    nprobe = enough_probes(placed, queries, cells, 0.9)
    hits = rows(approximate_top_k(placed, queries, cells, nprobe))
    assert len(pairs & {(q, hit[0]) for (q, _), hit in hits.items()}) >= 0.9 * len(pairs)
    assert enough_probes(placed, queries, cells, 1.01) == 12  # all cells, if nothing less will do


def test_codes_find_most_hits_and_rank_them_exactly(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32)  # more rows than a part has centres
    frame = stored(spark.createDataFrame([(at, row.tolist()) for at, row in enumerate(vectors)] + [(9000, None)], "vec_id long, embedding array<float>"), "vectors")
    books = fit_codebooks(frame, parts=7, id_col="vec_id", train_rows=1500)  # parts of unequal width
    codes = books.encode(vectors)
    assert codes.shape == (3000, 7) and codes.dtype == np.uint8
    # A code names the nearest centre of each part, and decoding gives those centres.
    cut = np.zeros((3000, 28))
    cut[:, :24] = vectors
    for part in range(7):
        gaps = ((cut[:50, None, part * 4:part * 4 + 4] - books.centres[part][None]) ** 2).sum(axis=2)
        assert np.allclose(gaps.min(axis=1), gaps[np.arange(50), codes[:50, part]])
    assert np.allclose(books.decode(codes)[3], np.concatenate([books.centres[part][codes[3, part]] for part in range(7)])[:24])
    coded = stored(encode(frame, books), "codes")
    assert coded.count() == 3000 and "embedding" not in coded.columns
    asked = spark.createDataFrame([(at, vectors[at].tolist(), 5) for at in range(0, 3000, 60)], "query_id long, embedding array<float>, k int")
    hits = coded_top_k(coded, frame, asked, books, id_col="vec_id").collect()
    found = {(row.query_id, row.vec_id) for row in hits}
    squared = ((vectors[::60][:, None, :].astype(float) - vectors[None]) ** 2).sum(axis=2)
    exact = {(60 * at, int(near)) for at, row in enumerate(squared) for near in np.argsort(row, kind="stable")[:5]}
    assert len(hits) == 250 and len(found & exact) >= 0.9 * len(exact)
    for row in hits:
        assert row.distance == pytest.approx(squared[row.query_id // 60, row.vec_id], abs=1e-9)
    assert {(row.query_id, row["rank"]) for row in hits} == {(at, rank) for at in range(0, 3000, 60) for rank in range(1, 6)}


def test_codes_of_few_vectors_are_exact(spark):
    rows = [(at, "a" if at % 2 else "b", [float(at), 1.0, 0.0]) for at in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, grp string, embedding array<double>")
    books = fit_codebooks(frame, parts=16, id_col="vec_id")
    asked = spark.createDataFrame([("q", "a", [7.2, 1.0, 0.0], 3)], "query_id string, grp string, embedding array<double>, k int")
    hits = coded_top_k(encode(frame, books), frame, asked, books, id_col="vec_id", by="grp").orderBy("rank").collect()
    assert [row.vec_id for row in hits] == [7, 9, 5]
    with pytest.raises(ValueError, match="no vectors"):
        fit_codebooks(frame.limit(0), id_col="vec_id")
