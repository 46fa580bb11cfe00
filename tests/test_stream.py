"""Streamed refresh: versions that come late, repeatedly and in any order, across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.embed import fit_hashed_tfidf
from gleaner.plans.build import chunks_of
from gleaner.sources import index
from gleaner.streaming.refresh import VERSIONED, stream_refresh


def versions(spark, rows):
    """Documents (doc_key, text, version) of the collection code; a text of None takes the document out."""
    frame = spark.createDataFrame([("code", *row) for row in rows], "collection string, doc_key string, text string, version long")
    frame = frame.withColumn("content_hash", content_hash(F.col("text")))
    return frame.select(*[
        (F.col(field.name) if field.name in frame.columns else F.lit(None)).cast(field.dataType).alias(field.name) for field in VERSIONED.fields])


@pytest.fixture(scope="module")
def model(spark):
    return fit_hashed_tfidf(spark.createDataFrame([("some words",), ("other words",)], "text string"), dim=32)


class Inbox:
    def __init__(self, spark, place, model):
        self.spark, self.model = spark, model
        self.root, self.folder, self.progress = (str(place / name) for name in ("root", "inbox", "progress"))

    def arrive(self, rows, files=1):
        versions(self.spark, rows).repartition(files).write.mode("append").parquet(self.folder)

    def run(self, progress="", **options):
        stream_refresh(self.spark, self.folder, self.root, "code", self.model, self.model.name, self.progress + progress,
                       **options).awaitTermination()
        return {r.doc_key: r.text for r in index.collection(self.spark, self.root, "code").collect()}


def test_late_and_repeated_versions(spark, tmp_path, model):
    inbox = Inbox(spark, tmp_path, model)
    inbox.arrive([("a", "one", 1), ("a", "three", 3), ("b", "first", 5), ("c", "gone soon", 1)])
    assert inbox.run() == {"a": "three", "b": "first", "c": "gone soon"}
    inbox.arrive([("a", "two", 2), ("b", "older", 4), ("c", None, 2), ("d", "new", 1)])  # after a restart from the checkpoint
    assert inbox.run() == {"a": "three", "b": "first", "d": "new"}
    before = index.versions(spark, inbox.root)
    inbox.arrive([("a", "one", 1), ("c", "gone soon", 1), ("b", "first", 5)])  # repeats, and a late one of a document taken out
    assert inbox.run() == {"a": "three", "b": "first", "d": "new"}
    assert index.versions(spark, inbox.root) == before  # nothing was written
    inbox.arrive([("c", "back", 3), ("d", " \n", 2)])
    assert inbox.run() == {"a": "three", "b": "first", "c": "back"}


def test_any_order_gives_one_outcome(spark, tmp_path, model):
    rng = random.Random(3)
    rows = [(f"k{key}", None if rng.random() < 0.2 else f"text {key} {version}", version) for key in range(6) for version in range(1, 5)]
    rows += [("tie", "one text", 7), ("tie", "another text", 7)]  # equal versions: what the document says decides
    outcomes = []
    for at in range(2):
        rng.shuffle(rows)
        inbox = Inbox(spark, tmp_path / str(at), model)
        inbox.arrive(rows[:9])
        inbox.run()
        inbox.arrive(rows[9:], files=2)
        outcomes.append(inbox.run(files_per_batch=1))
    last = {f"k{key}": text for key in range(6) for name, text, version in rows if name == f"k{key}" and version == 4 and text}
    assert outcomes[0] == outcomes[1] and {key: text for key, text in outcomes[0].items() if key != "tie"} == last
    assert "tie" in outcomes[0]


def test_without_versions_the_later_file_counts(spark, tmp_path, model):
    inbox = Inbox(spark, tmp_path, model)
    inbox.arrive([("a", "one", None)])
    inbox.run()
    inbox.arrive([("a", "two", None), ("b", "b", None)])
    assert inbox.run() == {"a": "two", "b": "b"}
    assert inbox.run(progress="2") == {"a": "two", "b": "b"}  # a new stream over all files ends alike
    assert chunks_of(index.collection(spark, inbox.root, "code").select("collection", "doc_key", "text", "file_path", "url", "repo", "source")).count() == 2


def test_versions_are_told_apart_by_keyed_state_without_python(spark, tmp_path, model):
    inbox = Inbox(spark, tmp_path, model)
    inbox.arrive([(f"k{at}", f"text {at}", 1) for at in range(50)], files=3)
    query = stream_refresh(spark, inbox.folder, inbox.root, "code", model, model.name, inbox.progress)
    query.awaitTermination()
    state = query.lastProgress["stateOperators"]
    assert [(part["operatorName"], part["numRowsTotal"]) for part in state] == [("stateStoreSave", 50)]
    inbox.arrive([("k1", "text 1", 1), ("k2", "older", 0), ("k3", "newer", 2)])
    assert inbox.run() == {f"k{at}": "newer" if at == 3 else f"text {at}" for at in range(50)}
    assert index.versions(spark, inbox.root)["code"].n_documents == 50
