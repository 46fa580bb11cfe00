"""Word counts against words taken one by one, and the size of what a worker holds."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.operators import embed
from gleaner.operators.cells import distinct_rows
from gleaner.plans import derived

TEXTS = ["", "\u00e9\u2014\u00c8 a_b", None, " x", "y ", "y", "\u0130 z\u00a0z", "\u0663\u0664 \u00bd x\u00b2", "\x00a\x01b", "w" * 55, "w" * 56, "w" * 200,
         "\u65e5\u672c\u8a9e text", "end"]


def test_word_counts():
    for texts in (pa.array(TEXTS), pa.array(TEXTS).slice(3, 6), pa.array(TEXTS, pa.large_string()), pa.array([], pa.string()), pa.array([""])):
        want = np.zeros((len(texts), 64), np.int64)
        for at, text in enumerate(pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()):
            for word in re.findall(r"\w+", text):
                want[at, int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % 64] += 1
        assert (embed.word_counts(texts, 64) == want).all()


def test_words_leave_nothing_in_a_worker():
    embed.word_counts(pa.array([f"word{at}" for at in range(1000)]), 64)
    assert not [name for name, value in vars(embed).items() if hasattr(value, "cache_info") and value.cache_info().currsize]


def test_rows_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    derived.table(spark, "/root/testdata/sf0.001", "documents")
    assert int(spark.conf.get(name)) <= 1000


def test_distinct_rows():
    rng = np.random.default_rng(4)
    rows = rng.integers(-2, 3, (200, 3)).astype(float) / 4
    rows[5] = -0.0
    rows[9] = [np.inf, -np.inf, -1e-300]
    for some in (rows, rows[:1], rows[:0]):
        assert (distinct_rows(some) == np.unique(some, axis=0)).all()
