"""Work that must not grow faster than the input: folders of cells, appends, removed keys, changes of the model."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.chunk import TOKEN_PATTERN, chunk_documents
from gleaner.operators.documents import union_documents
from gleaner.operators.embed import HashedTfIdf
from gleaner.operators.knn import top_k
from gleaner.plans import derived, layout, reembed
from gleaner.plans.build import build_index
from gleaner.plans.layout import cell_search, lay_out
from gleaner.plans.refresh import refresh
from gleaner.sources import index

ONE = HashedTfIdf((1.0,) * 16)


def documents(spark, own):
    rows = [("docs", key, text, key, "s") for key, text in own.items()]
    frame = spark.createDataFrame(rows, "collection string, doc_key string, text string, file_path string, source string")
    return union_documents(frame.withColumn("content_hash", content_hash(F.col("text"))))


@pytest.fixture
def shuffled(spark):
    """No join is broadcast because Spark guesses that it may."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in old.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def vectors(spark, root):
    rng = np.random.default_rng(3)
    rows = [("docs", f"d{at}", 0, f"c{at:04d}", rng.normal(size=8).astype(np.float32).tolist()) for at in range(600)]
    chunks = spark.createDataFrame(rows, "collection string, doc_key string, chunk_no int, chunk_id string, embedding array<float>")
    index.write_index(chunks, root, ["docs"], "m", "rebuild", 4)
    return spark.createDataFrame([(f"q{at}", "docs", 5, rows[at][4]) for at in range(4)],
                                 "query_id string, collection string, k int, embedding array<float>")


def ranked(hits, key):
    return sorted((r.query_id, r["rank"], r[key].split("|")[0]) for r in hits.collect())


def folders(root, version):
    return os.listdir(f"{layout.cells_path(root, version.layout)}/collection=docs")


def test_small_cells_share_a_folder(spark, tmp_path):
    root = str(tmp_path)
    asked = vectors(spark, root)
    version = lay_out(spark, root, "docs", rows_per_cell=4)
    balls = layout._balls(spark, root, [version])
    assert len(folders(root, version)) <= balls[0].count() < balls[1].count() / 5
    want = ranked(top_k(index.collection(spark, root, "docs"), asked, by="collection"), "chunk_id")
    assert ranked(cell_search(spark, root, [version], asked), "place") == want
    assert ranked(cell_search(spark, root, [version], asked, max_broadcast=0), "place") == want


def test_a_layout_of_one_folder_per_cell_is_still_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    asked = vectors(spark, root)
    monkeypatch.setattr(layout, "ROWS_PER_CELL", 1)
    version = lay_out(spark, root, "docs", rows_per_cell=20)
    cells, centres = layout.cells_path(root, version.layout), layout.centres_path(root, version.layout)
    assert len(folders(root, version)) == layout._balls(spark, root, [version])[1].count()
    old_cells, old_centres = spark.read.parquet(cells).drop("own_cell"), spark.read.parquet(centres)
    old_key = F.when(F.col("level") == 1, layout.cell_key(F.col("collection"), F.col("cell"))).otherwise(F.col("cell_key"))
    former = index.replace(version, layout="former")
    old_cells.write.partitionBy("collection", "cell").parquet(layout.cells_path(root, "former"))
    old_centres.withColumn("cell_key", old_key).write.parquet(layout.centres_path(root, "former"))
    assert ranked(cell_search(spark, root, [former], asked), "place") == ranked(cell_search(spark, root, [version], asked), "place")


def test_an_append_embeds_no_known_document(spark, tmp_path, shuffled):
    root = str(tmp_path)

    class Picky:
        """Of the same name and weights, but refuses texts that are known."""

        name, fingerprint, embed = ONE.name, ONE.fingerprint, staticmethod(ONE())

        def __call__(self):
            def checked(texts):
                assert not any("known" in text for text in texts.to_pylist())
                return self.embed(texts)

            return checked

    picky = Picky()
    own = {f"k{at}": f"known text {at}" for at in range(20)}
    build_index(documents(spark, own), root, ["docs"], ONE, ONE.name, "append")
    own["k20"] = "a later text"
    assert build_index(documents(spark, own), root, ["docs"], picky, picky.name, "append") == {"docs": (1, 1)}
    assert build_index(documents(spark, own), root, ["docs"], picky, picky.name, "append") == {"docs": (0, 0)}
    assert index.collection(spark, root, "docs").count() == 21


def test_vectors_are_not_shuffled_to_leave_out_removed_keys(spark, tmp_path, shuffled, monkeypatch):
    root = str(tmp_path)
    own = {f"k{at}": f"text {at}" for at in range(30)}
    build_index(documents(spark, own), root, ["docs"], ONE, ONE.name)
    refresh(documents(spark, {key: text for key, text in own.items() if key != "k3"}), root, "docs", ONE, ONE.name)
    live = index.collection(spark, root, "docs")
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = sorted(r.doc_key for r in live.collect())
    monkeypatch.setattr(index, "BROADCAST_KEYS", 0)  # too many keys: what meets them is told by a hash
    told = index.ensure_index(spark, root, [F.size("embedding").alias("dims")])
    assert "SortMergeJoin" in told._jdf.queryExecution().executedPlan().toString()
    assert not {"text", "embedding"} & set(told.columns) and {r.dims for r in told.collect()} == {16}
    assert want == sorted(r.doc_key for r in told.collect()) == sorted(set(own) - {"k3"})


def test_a_change_of_model_moves_texts_and_no_vectors(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path), []
    build_index(documents(spark, {f"k{at}": f"text {at}" for at in range(10)}), root, ["docs"], ONE, ONE.name)
    embed = reembed.embed_chunks

    def watched(rows, *rest):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return embed(rows, *rest)

    monkeypatch.setattr(reembed, "embed_chunks", watched)
    reembed.reembed(spark, root, "docs", HashedTfIdf((2.0,) * 16), ONE.name)
    assert seen and all("Rebalance" in plan for plan in seen)


def test_a_model_is_fitted_without_an_index(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(at, f"text {at}", "en", "src1", 6) for at in range(5)],
                          "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    built, build = [], derived.build_index
    monkeypatch.setattr(derived, "build_index", lambda *a: built.append(a) or build(*a))
    root, model = derived.fitted(spark, str(tmp_path))
    assert not built and derived.index(spark, str(tmp_path)) == derived.index(spark, str(tmp_path)) == (root, model) and len(built) == 1


def test_windows_of_runs_are_windows_of_tokens(spark):
    rng = np.random.default_rng(5)
    texts = [" \n" * (at % 2) + "".join("é" * int(rng.integers(1, 4)) + " \t\n"[int(rng.integers(0, 3))] * int(rng.integers(1, 3)) for _ in range(at))
             for at in (1, 3, 4, 5, 6, 11, 12, 13, 40)] + ["w " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    for size, overlap in ((6, 2), (6, 4), (5, 0), (7, 3), (512, 64)):
        want = set()
        for doc, text in enumerate(texts):
            tokens, stride = re.findall(TOKEN_PATTERN, text), size - overlap
            for at in range(max(1, -(-(len(tokens) - overlap) // stride))):
                want.add((doc, at, "".join(tokens[at * stride:at * stride + size])))
        assert {(r.doc, r.chunk_no, r.text) for r in chunk_documents(rows, size=size, overlap=overlap).collect()} == want
