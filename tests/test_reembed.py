"""Change of a collection's model: interruption, equal vectors, refusal of the old model."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.documents import union_documents
from gleaner.operators.embed import HashedTfIdf, fit_hashed_tfidf
from gleaner.plans import reembed as plan
from gleaner.plans.build import build_index, load_model, save_model
from gleaner.plans.refresh import refresh
from gleaner.plans.reembed import reembed
from gleaner.plans.search import search
from gleaner.sources import index


def documents(spark, texts):
    frame = spark.createDataFrame([("docs", key, text, key) for key, text in texts.items()],
                                  "collection string, doc_key string, text string, file_path string")
    return union_documents(frame.withColumn("content_hash", content_hash(F.col("text"))))


def vectors(spark, root):
    return {(r.doc_key, r.chunk_no): (r.text, tuple(r.embedding), r.embed_model) for r in index.collection(spark, root, "docs").collect()}


def test_an_interrupted_change_of_model_goes_on(spark, tmp_path, monkeypatch):
    texts = {f"k{at}": f"mesh solver item{at} " + "word " * (at % 7) for at in range(40)}
    one = fit_hashed_tfidf(documents(spark, texts), dim=32)
    two = HashedTfIdf(tuple(weight * (1 + at % 3) for at, weight in enumerate(one.weights)))
    root, fresh = str(tmp_path / "index"), str(tmp_path / "fresh")
    build_index(documents(spark, texts), root, ["docs"], one, one.name, n_buckets=8)
    texts["k3"] = "changed before the model changes"
    refresh(documents(spark, texts), root, "docs", one, one.name)
    before = vectors(spark, root)

    write, calls = plan._write, []

    def dies_later(rows, *rest):
        calls.append(rows)
        if len(calls) == 3:
            rows.limit(1).count()
            raise KeyboardInterrupt
        write(rows, *rest)

    monkeypatch.setattr(plan, "_write", dies_later)
    with pytest.raises(KeyboardInterrupt):
        reembed(spark, root, "docs", two, two.name, buckets_per_job=2)
    assert vectors(spark, root) == before  # the old vectors are found until all is done
    assert [r.doc_key for r in search(spark, root, spark.createDataFrame(
        [("q", "docs", "changed", 1)], "query_id string, collection string, query string, n_results int"), one).select(
        F.col("label").alias("doc_key")).collect()] == ["k3"]
    reembed(spark, root, "docs", two, two.name, buckets_per_job=2)
    assert len(calls) == 5  # two jobs were done, one was broken off, two were left
    build_index(documents(spark, texts), fresh, ["docs"], two, two.name, n_buckets=8)
    assert vectors(spark, root) == vectors(spark, fresh)
    version = index.versions(spark, root)["docs"]
    assert (version.n_chunks, version.n_documents, version.fingerprint) == (40, 40, two.fingerprint)
    with pytest.raises(ValueError, match="other weights"):
        refresh(documents(spark, texts), root, "docs", one, one.name)
    index.vacuum(spark, root)
    assert vectors(spark, root) == vectors(spark, fresh)


def test_models_are_found_by_their_weights(spark, tmp_path):
    root = str(tmp_path)
    one, two = HashedTfIdf((1.0, 2.0)), HashedTfIdf((2.0, 1.0))
    for model in (one, two):
        save_model(spark, root, model)
    assert one.fingerprint != two.fingerprint and load_model(spark, root) == two
    assert load_model(spark, root, one.fingerprint) == one
