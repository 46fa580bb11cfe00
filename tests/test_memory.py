"""What Python workers hold: one evaluation per stage, no workers for small sides, bounded pieces of vectors and runs of text."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import near_dup, packing
from gleaner.operators import knn
from gleaner.operators.cells import Cells, _cells_where, _probes
from gleaner.session import small_side


def evaluations(frame):
    """Python evaluations of an optimized plan."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_cells_of_queries_are_ranked_once(spark):
    rows = [(at, [float(at), 1.0], 2) for at in range(20)] + [(20, None, 2)]
    queries = spark.createDataFrame(rows, "query_id long, embedding array<float>, k int")
    cells = Cells(np.array([[0.0, 0.0], [5.0, 0.0], [9.0, 0.0]], np.float32))
    near = _probes(queries, cells, {0: 1.0, 1: 1.0, 2: 1.0}).withColumn("cell", _cells_where(lambda probe: probe["order"] < 2))
    routed = near.select("query_id", F.explode("cell").alias("cell")).join(
        spark.createDataFrame([(0,), (1,), (2,)], "cell int").hint("broadcast"), "cell")
    assert evaluations(routed) == 1
    got = {}
    for row in routed.collect():
        got.setdefault(row["query_id"], set()).add(row["cell"])
    assert got == {at: {0, 1} if at < 5 else {1, 2} for at in range(20)}


def test_sketches_are_compared_once(spark):
    def sketch(name):
        return b"".join(hashlib.blake2b(f"{name}{at}".encode(), digest_size=2).digest() for at in range(near_dup.HASHES))

    rows = [("same", sketch("a"), sketch("a")), ("apart", sketch("a"), sketch("b"))]
    pairs = spark.createDataFrame(rows, "name string, left binary, right binary").withColumn(
        "alike", near_dup._alike("left", "right")).filter(F.col("alike") >= near_dup.LIKELY).select("name", "alike")
    assert evaluations(pairs) == 1
    assert [tuple(row) for row in pairs.collect()] == [("same", 1.0)]


def test_texts_are_encoded_in_runs_of_bounded_size():
    texts = ["a" * 50, "é" * 30, "", "b" * 500, "c", "d" * 99, ""]
    found = list(packing.runs(pa.array(["x" * 999, *texts]).slice(1), 100))
    assert [text for some in found for text in some] == texts
    assert all(len(some) == 1 or sum(len(text.encode()) for text in some) <= 100 for some in found)
    assert list(packing.runs(pa.array([], pa.string()), 100)) == []
    assert list(packing.runs(pa.array(["", ""]), 100)) == [["", ""]]


def test_small_sides_need_no_python_on_executors(spark):
    rows = spark.range(7).selectExpr("id", "array(cast(id as float), null) AS vector", "if(id = 3, null, 'x') AS name")
    side = small_side(rows)
    plan = side._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "RDD" not in plan
    assert side.schema == rows.schema and sorted(side.collect()) == sorted(rows.collect())
    assert small_side(rows.where("id < 0")).collect() == []
    assert small_side(rows, 6) is rows


def test_exact_search_holds_pieces_of_bounded_size(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(130, 4)).astype(np.float32)
    vectors[40:70] = vectors[3]  # copies: more than a piece, ties go to the lower id
    held = []

    def distances(queries, rows, *others):
        held.append((len(queries), len(rows)))
        return whole(queries, rows, *others)

    whole = knn._distances
    monkeypatch.setattr(knn, "_distances", distances)
    monkeypatch.setattr(knn, "INDEX_PIECE_ROWS", 16)
    monkeypatch.setattr(knn, "MAX_DISTANCES", 48)
    lists = pa.chunked_array([pa.array(vectors[:90].tolist(), pa.list_(pa.float32())), pa.array(vectors[90:].tolist(), pa.list_(pa.float32()))])
    counts = [5, 1, 40, 200, 5, 5, 17]  # fewer and more than a piece, more than there are rows
    asked = pa.table({"k": pa.array(counts, pa.int32()), "bound": pa.array([np.inf] * len(counts))})
    best = knn._Best(asked)
    best.offer(np.array([0, 1, 2, 3, 4, 6]), vectors[:len(counts)].astype(float), np.arange(130), lists, "l2sq")
    assert sum(one * two for one, two in held) == 6 * 130
    assert all(two <= 16 and one * two <= 48 for one, two in held)
    gaps = ((vectors[:, None].astype(float) - vectors[None]) ** 2).sum(axis=2)
    for at, count in enumerate(counts):
        near = sorted((round(float(gap), 6), place) for place, gap in enumerate(gaps[at]))[:count]
        assert [hit[1] for hit in best.hits[at]] == ([] if at == 5 else [place for _, place in near])
