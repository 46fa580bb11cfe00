"""Index storage, search, statuses and refresh."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.documents import union_documents
from gleaner.operators.embed import fit_hashed_tfidf
from gleaner.plans import search as search_plan
from gleaner.plans.build import build_index, chunks_of, fit_model, load_model
from gleaner.plans.refresh import changes, refresh
from gleaner.plans.search import render, search
from gleaner.plans.status import collection_counts, coverage, health, query_status
from gleaner.schema import DOCUMENTS
from gleaner.sources import index
from gleaner.streaming.refresh import stream_refresh

TEXTS = {
    "code": {"solver.py": "adjoint solver loop", "mesh.py": "mesh reader and writer", "run.py": "run the case"},
    "docs": {"install.md": "how to install the solver", "mesh.md": "mesh guide"},
}


def documents(spark, texts):
    rows = [(c, key, text, key) for c, docs in texts.items() for key, text in docs.items()]
    frame = spark.createDataFrame(rows, "collection string, doc_key string, text string, file_path string")
    return union_documents(frame.withColumn("content_hash", content_hash(F.col("text"))))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    everything = documents(spark, TEXTS)
    model = fit_model(everything, root)
    build_index(everything, root, ("code", "docs", "tests"), model, model.name)
    return root, model


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, collection string, query string, n_results int")


def names(spark):
    return spark.createDataFrame([("code",), ("docs",), ("tests",), ("tutorials",)], "collection string")


def keys(spark, root, name):
    return sorted(r.doc_key for r in index.collection(spark, root, name).collect())


def test_model_is_stored_with_the_index(spark, built):
    root, model = built
    assert load_model(spark, root) == model


def test_search(spark, built):
    root, model = built
    asked = queries(
        spark, ("a", "code", "mesh reader", 1), ("b", "docs", "install", None), ("c", "code", "solver", 50),
        ("d", "code", "solver", 0), ("e", "tests", "solver", 5), ("f", "gone", "solver", 5),
    )
    hits = search(spark, root, asked, model)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.label)
    assert got["a"] == ["mesh.py"]
    assert got["b"][0] == "install.md" and len(got["b"]) == 2
    assert got["c"][0] == "solver.py" and len(got["c"]) == 3
    assert set(got) == {"a", "b", "c"}
    with pytest.raises(ValueError, match="holds vectors of"):
        search(spark, root, asked, type(model)(model.weights[:8]))
    best = hits.where("query_id = 'a'").first()
    assert best.score == round(1 - best.distance, 3)
    text = render(hits).where("query_id = 'b'").first().rendered
    assert text.count("\n\n---\n\n") == 1 and text.startswith("**install.md** (score: ")
    assert "```\nhow to install the solver\n```" in text


def test_bounded_search_is_the_same(spark, built, monkeypatch):
    root, model = built
    asked = queries(spark, ("a", "code", "mesh reader", 2), ("b", "docs", "install", None))
    plain = search(spark, root, asked, model).select("query_id", "rank", "chunk_id").collect()
    monkeypatch.setattr(search_plan, "BOUND_PARTITIONS", 0)
    bounded = search(spark, root, asked, model).select("query_id", "rank", "chunk_id").collect()
    assert sorted(plain) == sorted(bounded)


def test_query_prefix_follows_the_stored_model(spark, tmp_path):
    def lengths():
        return lambda texts: np.array([[len(t.as_py())] for t in texts], dtype=float)

    root = str(tmp_path)
    build_index(documents(spark, TEXTS), root, ["code"], lengths, "some-e5-model")
    asked = queries(spark, ("a", "code", "xy", 1))
    prepared = search_plan.prepare_queries(asked, index.catalog(spark, root), lengths)
    assert prepared.first().embedding == [len("query: xy")]


def test_statuses_counts_and_health(spark, built):
    root, model = built
    asked = queries(
        spark, ("ok", "code", "mesh", 1), ("none", "code", "mesh", 0), ("empty", "tests", "x", 1),
        ("missing", "tutorials", "x", 1), ("unknown", "elsewhere", "x", 1),
    )
    catalog = index.catalog(spark, root)
    hits = search(spark, root, asked, model)
    statuses = query_status(asked, hits, catalog, names(spark))
    assert {r.query_id: r.status for r in statuses.collect()} == {
        "ok": "ok", "none": "no_results", "empty": "empty", "missing": "missing", "unknown": "unknown"}
    assert coverage(statuses).agg(F.sum("n_queries")).first()[0] == 5
    assert {r.collection: r.n_chunks for r in collection_counts(catalog, names(spark)).collect()} == {
        "code": 3, "docs": 2, "tests": 0, "tutorials": 0}
    assert {r.collection: (r.n_chunks, r.embed_model) for r in health(catalog, names(spark)).collect()} == {
        "code": (3, model.name), "docs": (2, model.name), "tests": (0, model.name), "tutorials": (None, None)}


def test_absent_index_is_empty(spark, tmp_path):
    assert index.ensure_index(spark, str(tmp_path / "no")).count() == 0
    assert index.catalog(spark, str(tmp_path / "no")).count() == 0


def test_append_adds_and_rebuild_replaces(spark, tmp_path):
    root = str(tmp_path)
    chunks = chunks_of(documents(spark, TEXTS))
    index.write_index(chunks, root, list(TEXTS), "m")
    index.write_index(chunks, root, ["code"], "m")
    assert index.collection(spark, root, "code").count() == 3
    with pytest.raises(ValueError, match="holds vectors of"):
        index.write_index(chunks, root, ["code"], "other")
    for _ in range(2):  # rebuilding twice gives the same
        index.write_index(chunks, root, ["code"], "m", "rebuild")
        assert keys(spark, root, "code") == sorted(TEXTS["code"])
    index.write_index(chunks.where("false"), root, ["code"], "m", "rebuild")
    assert keys(spark, root, "code") == []
    assert keys(spark, root, "docs") == sorted(TEXTS["docs"])
    assert {r.collection for r in index.catalog(spark, root).collect()} == set(TEXTS)
    with pytest.raises(ValueError):
        index.write_index(chunks, root, ["a/b"], "m")


def test_collection_scan_reads_its_own_files(spark, built):
    plan = index.collection(spark, built[0], "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection" in plan


def files_of(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs
            if f.endswith(".parquet")}


def test_refresh(spark, tmp_path):
    root = str(tmp_path)
    model = fit_hashed_tfidf(chunks_of(documents(spark, TEXTS)))

    def update(texts, **options):
        refresh(documents(spark, {"code": texts}), root, "code", model, model.name, **options)
        return {r.doc_key: r.text for r in index.collection(spark, root, "code").collect()}

    first = {f"k{i}": f"text number {i}" for i in range(20)}
    assert update(first) == first
    before = files_of(root)
    assert update(first) == first
    assert files_of(root) == before  # nothing was written

    second = {k: v for k, v in first.items() if k not in ("k3", "k4")} | {"k5": "edited", "new": "fresh"}
    assert update(second) == second
    assert set(before) <= set(files_of(root))  # no file is rewritten

    third = {"k6": "edited too", "new2": "more"}
    assert update(third, full_snapshot=False) == second | third
    renamed = documents(spark, {"code": second | third}).withColumn("branch", F.lit("next"))
    refresh(renamed, root, "code", model, model.name)  # metadata alone
    assert {r.branch for r in index.collection(spark, root, "code").collect()} == {"next"}
    assert update({"only": "one"}) == {"only": "one"}
    assert update({}) == {}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "doc_key string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "doc_key string, content_hash string")
    assert {r.doc_key: r.change for r in changes(old, new).collect()} == {
        "a": "unchanged", "b": "changed", "c": "removed", "d": "added"}


def test_stream_refresh(spark, tmp_path):
    root, inbox, progress = (str(tmp_path / name) for name in ("root", "inbox", "progress"))
    model = fit_hashed_tfidf(chunks_of(documents(spark, TEXTS)))

    def arrive(texts):
        documents(spark, {"code": texts}).write.mode("append").parquet(inbox)
        stream_refresh(spark, inbox, root, "code", model, model.name, progress).awaitTermination()
        return {r.doc_key: r.text for r in index.collection(spark, root, "code").collect()}

    assert arrive({"a": "1", "b": "1"}) == {"a": "1", "b": "1"}
    assert arrive({"a": "1", "b": "2", "c": "1"}) == {"a": "1", "b": "2", "c": "1"}
    before = files_of(root)
    assert arrive({"c": "1"}) == {"a": "1", "b": "2", "c": "1"}
    assert files_of(root) == before
    # A new stream over the same folder repeats all of it, ending in the same index.
    stream_refresh(spark, inbox, root, "code", model, model.name, progress + "2").awaitTermination()
    assert {r.doc_key: r.text for r in index.collection(spark, root, "code").collect()} == {"a": "1", "b": "2", "c": "1"}


def test_documents_layout(spark):
    assert documents(spark, TEXTS).schema == DOCUMENTS
