"""Versioned collections, merge-on-read refresh, cells: interruptions, files written and files read."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.documents import union_documents
from gleaner.operators.embed import fit_hashed_tfidf
from gleaner.operators.knn import top_k
from gleaner.plans import layout
from gleaner.plans.build import build_index, chunks_of
from gleaner.plans.layout import cell_pairs, cell_search, in_cells, lay_out
from gleaner.plans.refresh import RefreshCounts, refresh
from gleaner.plans.search import search
from gleaner.session import stored
from gleaner.sources import index

WORDS = "adjoint solver mesh reader writer case loop guide install tool field flux matrix vector sparse".split()


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    return {f"k{at}": " ".join(rng.choice(WORDS, 8)) + f" item{at}" for at in range(n)}


def documents(spark, own, collection="docs"):
    rows = [(collection, key, text, key, "s") for key, text in own.items()]
    frame = spark.createDataFrame(rows, "collection string, doc_key string, text string, file_path string, source string")
    return union_documents(frame.withColumn("content_hash", content_hash(F.col("text"))))


@pytest.fixture(scope="module")
def model(spark):
    return fit_hashed_tfidf(chunks_of(documents(spark, texts(300))), dim=64)


def build(spark, root, own, model, mode="rebuild", **options):
    return build_index(documents(spark, own), root, ["docs"], model, model.name, mode, **options)


def held(spark, root):
    return {r.doc_key: r.text for r in index.collection(spark, root, "docs").collect()}


def parquet_files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def queries(spark, own, k=3):
    return spark.createDataFrame([(f"q{at}", "docs", text, k) for at, text in enumerate(own)],
                                 "query_id string, collection string, query string, n_results int")


def found(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.distance, 6), r.text) for r in hits.collect())


# Versions.


class Killed(Exception):
    pass


def test_a_rebuild_that_dies_leaves_the_old_hits(spark, tmp_path, model, monkeypatch):
    root = str(tmp_path)
    build(spark, root, texts(20), model)
    asked = queries(spark, ["mesh reader", "install guide"])
    before, old = found(search(spark, root, asked, model)), index.versions(spark, root)

    def die(*_):
        raise Killed

    monkeypatch.setattr(index, "commit", die)  # all is written, the switch is not done
    for change in (lambda: build(spark, root, texts(30, seed=2), model), lambda: build(spark, root, texts(30), model, "append"),
                   lambda: refresh(documents(spark, texts(5, seed=3)), root, "docs", model, model.name),
                   lambda: index.compact(spark, root, "docs"), lambda: lay_out(spark, root, "docs", 8)):
        with pytest.raises(Killed):
            change()
        assert found(search(spark, root, asked, model)) == before
        assert index.versions(spark, root) == old
    monkeypatch.undo()
    # A version folder that was begun, but has no row, counts for nothing and is in nobody's way.
    os.makedirs(f"{root}/versions/collection=docs/version={old['docs'].number + 1}/_temporary/0")
    assert index.versions(spark, root) == old
    build(spark, root, texts(30, seed=2), model)
    assert held(spark, root) == texts(30, seed=2)
    files = parquet_files(root)
    index.vacuum(spark, root)  # what the dead attempts and the old version left
    assert len(parquet_files(root)) < len(files)
    assert held(spark, root) == texts(30, seed=2)
    assert index.vacuum(spark, root) == []


def test_a_change_by_another_job_meanwhile_is_refused(spark, tmp_path, model):
    root = str(tmp_path)
    build(spark, root, texts(5), model)
    old = index.versions(spark, root)["docs"]
    refresh(documents(spark, texts(6)), root, "docs", model, model.name)
    with pytest.raises(RuntimeError, match="changed by another job"):
        index.replace_documents(old, spark.createDataFrame([("k0",)], "doc_key string"), chunks_of(documents(spark, {})), root)
    assert held(spark, root) == texts(6)


def test_a_reader_sees_one_version(spark, tmp_path, model):
    root = str(tmp_path)
    build(spark, root, texts(12), model)
    reader = index.collection(spark, root, "docs")
    build(spark, root, texts(3, seed=9), model)
    assert {r.doc_key for r in reader.collect()} == set(texts(12))
    assert held(spark, root) == texts(3, seed=9)


def test_one_changed_document_writes_its_own_chunks(spark, tmp_path, model):
    root = str(tmp_path)
    own = texts(200)
    build(spark, root, own, model)
    before = parquet_files(root)
    own["k7"] = "changed text"
    counts = refresh(documents(spark, own), root, "docs", model, model.name)
    assert counts == RefreshCounts(0, 1, 0, 0)
    new = parquet_files(root) - before
    assert before <= parquet_files(root)
    written = [f for f in new if "/chunks/" in f]
    assert sum(spark.read.parquet(f).count() for f in written) == 1
    assert held(spark, root) == own
    del own["k8"]
    assert refresh(documents(spark, own), root, "docs", model, model.name) == RefreshCounts(0, 0, 1, -1)
    own["k8"] = "back again"  # removed before, added now: the older removal does not touch it
    assert refresh(documents(spark, own), root, "docs", model, model.name) == RefreshCounts(1, 0, 0, 1)
    assert held(spark, root) == own
    assert index.catalog(spark, root).first().n_chunks == len(own) == index.versions(spark, root)["docs"].n_documents


def test_any_order_of_changes_equals_a_fresh_build(spark, tmp_path, model):
    root, fresh = str(tmp_path / "a"), str(tmp_path / "b")
    rng, own = np.random.default_rng(4), texts(40)
    build(spark, root, own, model)
    for step in range(6):
        for key in rng.choice(sorted(own), 5, replace=False):
            if rng.random() < 0.4:
                del own[key]
            else:
                own[key] = f"{' '.join(rng.choice(WORDS, 5))} step{step}"
        own[f"new{step}"] = "added text"
        refresh(documents(spark, own), root, "docs", model, model.name)
        if step == 2:
            index.compact(spark, root, "docs")
        if step == 3:
            lay_out(spark, root, "docs", 6)
        version = index.versions(spark, root)["docs"]
        assert held(spark, root) == own
        assert (version.n_chunks, version.n_documents) == (len(own), len(own))
    build(spark, fresh, own, model)
    asked = queries(spark, ["mesh reader", "sparse matrix", "step5"], 7)
    assert found(search(spark, root, asked, model)) == found(search(spark, fresh, asked, model))
    index.compact(spark, root, "docs")
    assert found(search(spark, root, asked, model)) == found(search(spark, fresh, asked, model))
    assert index.versions(spark, root)["docs"].removed == ()


def test_repeated_keys_of_one_batch_give_one_document(spark, tmp_path, model):
    root = str(tmp_path)
    twice = documents(spark, {"a": "first text", "b": "other"}).unionByName(documents(spark, {"a": "second text"}))
    assert build_index(twice, root, ["docs"], model, model.name, "append") == {"docs": (2, 2)}
    assert set(held(spark, root)) == {"a", "b"} and index.collection(spark, root, "docs").count() == 2
    refresh(twice, root, "docs", model, model.name)
    assert index.collection(spark, root, "docs").count() == 2


def test_chunk_options_stay_with_the_collection(spark, tmp_path, model):
    root = str(tmp_path)
    own = {"a": " ".join(f"w{at}" for at in range(25))}
    build(spark, root, own, model, chunking="window", size=10, overlap=2, with_metadata=True)
    assert index.collection(spark, root, "docs").count() == 3
    with_lines = index.collection(spark, root, "docs").orderBy("chunk_no").first().embedding
    own["b"] = own["a"] + " end"
    refresh(documents(spark, own), root, "docs", model, model.name)
    assert index.collection(spark, root, "docs").where("doc_key = 'b'").count() == 3
    build(spark, root, own | {"c": own["a"]}, model, "append")
    assert index.collection(spark, root, "docs").where("doc_key = 'c'").count() == 3
    build(spark, str(tmp_path / "plain"), {"a": own["a"]}, model, size=10, overlap=2)
    plain = index.collection(spark, str(tmp_path / "plain"), "docs").orderBy("chunk_no").first().embedding
    assert plain != with_lines
    options = index.versions(spark, root)["docs"].options
    assert options == index.Options("window", 10, 2, True)


def test_other_weights_of_the_same_width_are_refused(spark, tmp_path, model):
    root = str(tmp_path)
    build(spark, root, texts(3), model)
    other = type(model)(tuple(weight + 1 for weight in model.weights))
    assert other.name == model.name
    for use in (lambda: search(spark, root, queries(spark, ["mesh"]), other), lambda: build(spark, root, texts(4), other, "append"),
                lambda: refresh(documents(spark, texts(4)), root, "docs", other, other.name)):
        with pytest.raises(ValueError, match="other weights"):
            use()


# Cells.


def scanned_files(frame):
    """Files that the scans of a frame opened, by the first column their folder is partitioned by."""
    frame._jdf.collectToPython()
    files = {}

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            paths = node.relation().location().rootPaths().mkString(",")
            kind = next((kind for kind in ("cells", "chunks", "centres") if f"/{kind}/" in paths), "other")
            files[kind] = files.get(kind, 0) + node.metrics().apply("numFiles").value()
        children = node.children()
        for at in range(children.size()):
            walk(children.apply(at))

    walk(frame._jdf.queryExecution().executedPlan())
    return files


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    """A collection of vectors in clusters far apart, laid out."""
    root = str(tmp_path_factory.mktemp("cells"))
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 8)) * 20
    rows = []
    for at in range(600):
        vector = (middles[at % 12] + rng.normal(size=8)).astype(np.float32).tolist()
        rows.append(("docs", f"d{at}", 0, f"text {at}", f"c{at:04d}", vector))
    rows += [("docs", f"same{at}", 0, "same", f"s{at:04d}", rows[0][5]) for at in range(200)]  # a third of all rows alike
    chunks = spark.createDataFrame(rows, "collection string, doc_key string, chunk_no int, text string, chunk_id string, embedding array<float>")
    index.write_index(chunks, root, ["docs"], "m", "rebuild", 4)
    lay_out(spark, root, "docs", rows_per_cell=20)
    return root, [row[5] for row in rows]


def asked_of(spark, vectors, k=5):
    return spark.createDataFrame([(f"q{at}", "docs", k, vector) for at, vector in enumerate(vectors)],
                                 "query_id string, collection string, k int, embedding array<float>")


def ranked(hits, key):
    return sorted((r.query_id, r["rank"], r[key].split("|")[0], round(r.distance, 6)) for r in hits.collect())


def test_cells_hold_every_row_within_their_radius(spark, laid_out):
    root, vectors = laid_out
    version = index.versions(spark, root)["docs"]
    rows = layout._cells(spark, root, [version])
    assert rows.count() == len(vectors)
    centres = spark.read.parquet(layout.centres_path(root, version.layout))
    cells = centres.where("level = 1")
    assert cells.count() > 12 and centres.where("level = 0").count() > 1
    gaps = rows.join(cells.drop("collection"), "cell").withColumn("gap", F.sqrt(layout._squared(F.col("embedding"), F.col("centre"))))
    assert gaps.where("gap > radius + 1e-5").count() == 0
    assert cells.agg(F.sum("n_rows")).first()[0] == len(vectors)


def test_cell_search_is_exact_and_reads_few_files(spark, laid_out):
    root, vectors = laid_out
    version = index.versions(spark, root)["docs"]
    rng = np.random.default_rng(7)
    asked = [vectors[3], vectors[0], (np.array(vectors[5]) + 0.1).astype(np.float32).tolist(), rng.normal(size=8).astype(np.float32).tolist()]
    chunks = index.collection(spark, root, "docs")
    for k in (1, 5, 230):  # more than the nearest cells hold
        questions = asked_of(spark, asked, k)
        assert ranked(cell_search(spark, root, [version], questions), "place") == ranked(
            top_k(chunks, questions, by="collection"), "chunk_id")
    one = asked_of(spark, [vectors[3]], 3)
    _, pairs = cell_pairs(spark, root, [version], one)
    rows = in_cells(layout._cells(spark, root, [version]), pairs)
    cells = len({row.cell for row in rows.select("cell").collect()})
    all_files = scanned_files(layout._cells(spark, root, [version]).select("place"))["cells"]
    read = scanned_files(rows.select("place"))["cells"]
    assert cells <= pairs.count() and read < all_files / 3
    assert set(pairs.columns) == {"query_id", "cell_key"}


def test_a_list_of_cells_too_long_is_not_sent(spark, laid_out, monkeypatch):
    root, vectors = laid_out
    version = index.versions(spark, root)["docs"]
    questions = asked_of(spark, vectors[:40], 4)
    want = ranked(cell_search(spark, root, [version], questions), "place")
    monkeypatch.setattr(layout, "MAX_PAIRS", 3)
    assert ranked(cell_search(spark, root, [version], questions), "place") == want


def test_search_reads_cells_beside_what_came_later(spark, tmp_path, model):
    root, plain = str(tmp_path / "cells"), str(tmp_path / "plain")
    own = texts(150)
    build(spark, root, own, model)
    assert lay_out(spark, root, "docs", 10).layout
    own |= {f"late{at}": f"mesh reader late{at}" for at in range(5)}
    del own["k3"]
    own["k4"] = "mesh reader edited"
    refresh(documents(spark, own), root, "docs", model, model.name)
    build(spark, plain, own, model)
    asked = queries(spark, ["mesh reader", "sparse matrix", "install guide tool", "item17"], 6)
    assert found(search(spark, root, asked, model)) == found(search(spark, plain, asked, model))
    many = queries(spark, list(own.values()), 2)
    want = found(search(spark, plain, many, model))
    assert found(search(spark, root, many, model)) == want
    lay_out(spark, root, "docs", 10)  # takes in what came later
    assert index.versions(spark, root)["docs"].covered == index.versions(spark, root)["docs"].segments
    assert found(search(spark, root, many, model)) == want
    assert found(search(spark, root, queries(spark, []), model)) == []


def test_many_queries_are_routed_to_cells(spark, laid_out, monkeypatch):
    root, vectors = laid_out
    version = index.versions(spark, root)["docs"]
    questions = asked_of(spark, vectors, 4)
    chunks = index.collection(spark, root, "docs")
    monkeypatch.setattr(layout, "INDEX_BLOCK_ROWS", 50)  # groups of queries are dealt over several tasks
    got = ranked(cell_search(spark, root, [version], questions, max_broadcast=0), "place")
    assert got == ranked(top_k(chunks, questions, by="collection"), "chunk_id")
    bounded, pairs = cell_pairs(spark, root, [version], questions, max_broadcast=0)
    few = cell_pairs(spark, root, [version], questions)[1]
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, few.collect()))
    n_cells = spark.read.parquet(layout.centres_path(root, version.layout)).where("level = 1").count()
    assert pairs.count() < len(vectors) * n_cells / 4  # most cells are ruled out
    assert bounded.where("bound is null").count() == 0


def shuffled_rows(frame):
    """Rows written to shuffles of a frame whose input is on disk."""
    frame._jdf.collectToPython()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for at in range(children.size()):
            walk(children.apply(at))

    walk(frame._jdf.queryExecution().executedPlan())
    return found


def test_an_index_row_is_shuffled_once_whatever_the_queries(spark, laid_out):
    root, vectors = laid_out
    chunks = index.collection(spark, root, "docs")
    counts = []
    for n in (10, 400):
        questions = stored(asked_of(spark, vectors[:n], 2), "questions")
        hits = top_k(chunks, questions, by="collection", max_broadcast=0)
        counts.append(max(shuffled_rows(hits)) - n)
    assert counts == [len(vectors)] * 2


def test_texts_of_other_buckets_are_not_read(spark, tmp_path, model):
    root = str(tmp_path)
    build(spark, root, texts(300), model, n_buckets=64)
    hits = search(spark, root, queries(spark, [texts(300)["k5"]], 1), model)
    read = scanned_files(hits.select("query_id", "text"))["chunks"]
    everything = scanned_files(index.ensure_index(spark, root).select("chunk_id"))["chunks"]
    assert everything >= 64 and read <= everything / 32


def test_layout_of_small_and_empty_collections(spark, tmp_path, model):
    root = str(tmp_path)
    build(spark, root, {}, model)
    assert lay_out(spark, root, "docs").layout is None
    assert found(search(spark, root, queries(spark, ["mesh"]), model)) == []
    build(spark, root, {"a": "mesh"}, model, "append")
    assert lay_out(spark, root, "docs").layout
    assert [row[4] for row in found(search(spark, root, queries(spark, ["mesh"]), model))] == ["mesh"]
    refresh(documents(spark, {"b": "other"}), root, "docs", model, model.name)
    assert [row[4] for row in found(search(spark, root, queries(spark, ["mesh"]), model))] == ["other"]


def test_many_queries_make_no_pairs_with_single_cells(spark, laid_out, monkeypatch):
    root, vectors = laid_out
    version = index.versions(spark, root)["docs"]
    monkeypatch.setattr(layout, "cell_pairs", None)
    monkeypatch.setattr(layout, "INDEX_BLOCK_ROWS", 50)
    questions = asked_of(spark, vectors, 5)
    assert ranked(cell_search(spark, root, [version], questions, max_broadcast=0), "place") == ranked(
        top_k(index.collection(spark, root, "docs"), questions, by="collection"), "chunk_id")
