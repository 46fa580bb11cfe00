"""Chunk windows, sentence packing and embeddings."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.operators.chunk import TOKEN_PATTERN, chunk_documents, pack_sentences
from gleaner.operators.embed import embed_text, fit_hashed_tfidf, word_counts
from gleaner.operators.mllib import mllib_embed, mllib_tfidf
from gleaner.plans.build import chunks_of, embed_chunks
from gleaner.schema import DOCUMENTS


def windows(spark, texts, **options):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {}
    for row in chunk_documents(documents, **options).orderBy("doc", "chunk_no").collect():
        got.setdefault(row.doc, []).append(row.text)
    return got


def test_window_counts(spark):
    sizes = [1, 64, 512, 513, 960, 961]
    got = windows(spark, [" ".join(f"w{i}" for i in range(n)) for n in sizes])
    assert [len(got[i]) for i in range(len(sizes))] == [1, 1, 1, 2, 2, 3]


def test_blank_documents_have_no_chunks(spark):
    assert windows(spark, ["", " \n\u2003", None, "x"]) == {3: ["x"]}


def rebuilt(chunks, overlap):
    tokens = [re.findall(TOKEN_PATTERN, chunk) for chunk in chunks]
    return "".join("".join(t if i == 0 else t[overlap:]) for i, t in enumerate(tokens))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t.é", max_size=120), min_size=5, max_size=20))
def test_windows_rebuild_the_text(spark, texts):
    got = windows(spark, texts, size=7, overlap=3)
    for doc, text in enumerate(texts):
        if text.strip():
            assert rebuilt(got[doc], 3) == text.lstrip(" \n\t")
            for chunk in got[doc]:
                assert len(re.findall(TOKEN_PATTERN, chunk)) <= 7


def test_bad_overlap():
    from gleaner.operators.chunk import window_chunks

    with pytest.raises(ValueError):
        window_chunks(F.lit("x"), 4, 4)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n", max_size=200), st.integers(2, 9), st.integers(0, 4))
def test_sentence_packing(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = [piece for _, piece in pack_sentences(text, size, overlap)]
    assert all(0 < len(re.findall(TOKEN_PATTERN, c)) <= size for c in chunks)
    place = 0
    for chunk in chunks:  # every chunk is a stretch of the text, and none is skipped
        at = text.find(chunk)
        assert at >= 0
        place += len(chunk)
    words = re.findall(r"[^ \n]+", text)
    assert set(words) == {w for c in chunks for w in re.findall(r"[^ \n]+", c)}
    assert place >= len(text.strip(" \n"))


def test_sentences_stay_whole(spark):
    text = "One two. Three four five! Six.\nSeven eight nine ten eleven."
    got = windows(spark, [text], mode="sentence", size=6, overlap=2)[0]
    assert got == ["One two. Three four five! Six.\n", "Six.\nSeven eight nine ten eleven."]


def words(text):
    return re.findall(r"[^\W]+", text.lower())


def test_embedding_against_plain_python(spark):
    dim = 64
    texts = ["Alpha beta beta, gamma!", "beta Über_x 42", "...", "alpha"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    model = fit_hashed_tfidf(frame, dim=dim)

    def bucket(word):
        return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim

    frequency = np.zeros(dim)
    for text in texts:
        for b in {bucket(w) for w in words(text)}:
            frequency[b] += 1
    idf = np.array([math.log((len(texts) + 1) / (f + 1)) for f in frequency])
    assert np.allclose(model.weights, idf)
    none = spark.createDataFrame([(9, None)], frame.schema)
    assert set(embed_text(none, model).first().embedding) == {0.0}
    for row in embed_text(frame, model, batch_size=2).collect():
        expected = np.zeros(dim)
        for w in words(row.text):
            expected[bucket(w)] += 1
        expected *= idf
        length = np.linalg.norm(expected)
        assert np.allclose(row.embedding, expected / (length or 1.0), atol=1e-6)


def test_word_counts_empty():
    assert word_counts(pa.array(["", "!!"]), 8).sum() == 0


def test_own_model_is_built_once_per_task_and_batched(spark):
    def factory():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            assert max(calls) <= 4
            return np.array([[len(t.as_py()), len(calls)] for t in texts], dtype=float)

        return embed

    frame = spark.createDataFrame([("x" * i,) for i in range(10)], "text string").coalesce(1)
    got = embed_text(frame, factory, batch_size=4).collect()
    assert [r.embedding[0] for r in got] == list(range(10))
    assert max(r.embedding[1] for r in got) == 3


def test_mllib_vectors_are_unit_length(spark):
    frame = spark.createDataFrame([("a b c",), ("b c d",), ("e",)], "text string")
    rows = mllib_embed(mllib_tfidf(64).fit(frame), frame).collect()
    assert all(math.isclose(np.linalg.norm(r.embedding), 1.0, abs_tol=1e-5) for r in rows)


def test_metadata_text_is_optional(spark):
    row = {f.name: None for f in DOCUMENTS.fields} | {
        "collection": "code", "doc_key": "k", "text": "alpha", "file_path": "beta.py", "priority": 3}
    documents = spark.createDataFrame([row], DOCUMENTS)
    seen = []

    def factory():
        return lambda texts: np.array([[len(t.as_py())] for t in texts], dtype=float)

    for with_metadata in (False, True):
        seen.append(embed_chunks(chunks_of(documents), factory, "m", with_metadata).first().embedding[0])
    assert seen == [5, len("file_path: beta.py\npriority: 3\nalpha")]
