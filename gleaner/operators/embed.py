"""Text to vectors, row by row in Arrow batches.

An embedder is a small picklable factory: called once per task, it returns a function from
an Arrow array of texts to a matrix with one row per text. The default one is a hashed TF-IDF whose
weights are fitted once and stored beside the index; a neural model plugs in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchFunction = Callable[[pa.Array], np.ndarray]
EMBED_DIM = 1024
FIT_ROWS = 2048
_VECTOR = T.ArrayType(T.FloatType())

# Words are runs of letters, digits and underscores.
WORD_BREAK = r"[^\p{L}\p{N}_]+"


# Bytes of words in lower-case text; others than ASCII are blanks by then, or belong to letters and digits.
_IN_WORD = np.array([byte >= 128 or chr(byte).isalnum() or byte == ord("_") for byte in range(256)])


# MD5: the constants and shifts of its rounds, and the bytes that fit into its first block.
_SINES = [np.uint32(int(abs(np.sin(at + 1)) * 2**32)) for at in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_BLOCK = 55


def _hashes(words: pa.Array) -> np.ndarray:
    """The first 28 bits of the MD5 of each of some large binaries, all words of one block at a time."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    kept = np.minimum(sizes, _BLOCK)
    block = np.zeros((n, 64), np.uint8)
    within = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    block.ravel()[within + np.repeat(np.arange(n) * 64, kept)] = data[within + np.repeat(ends[:-1], kept)]
    block[np.arange(n), kept] = 0x80
    block.view("<u4")[:, 14] = kept * 8
    parts = np.ascontiguousarray(block.view("<u4").T)
    start = [np.full(n, value, np.uint32) for value in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for at in range(64):
        turn = at // 16
        mixed = d ^ (b & (c ^ d)) if turn == 0 else c ^ (d & (b ^ c)) if turn == 1 else b ^ c ^ d if turn == 2 else c ^ (b | ~d)
        place = (at, 5 * at + 1, 3 * at + 5, 7 * at)[turn] % 16
        total = a + mixed + _SINES[at] + parts[place]
        shift = np.uint32(_SHIFTS[turn][at % 4])
        a, d, c, b = d, c, b, b + ((total << shift) | (total >> (np.uint32(32) - shift)))
    found = ((a + start[0]).byteswap() >> np.uint32(4)).astype(np.int64)
    for at in np.flatnonzero(sizes > _BLOCK):
        long = data[ends[at]:ends[at + 1]].tobytes()
        found[at] = int.from_bytes(hashlib.md5(long, usedforsecurity=False).digest()[:4], "big") >> 4
    return found


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lower-case words of texts in their order, as bytes, and the text each is from."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    if not pc.all(pc.string_is_ascii(lowered)).as_py():
        lowered = pc.replace_substring_regex(lowered, r"[^\x00-\x7F\p{L}\p{N}]+", " ")
    _, ends, data = lowered.buffers()
    ends = np.frombuffer(ends, np.int64)[lowered.offset:lowered.offset + len(lowered) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = ends[:-1] < ends[1:]  # no word goes on in the next text
    first[ends[:-1][filled]] = inside[ends[:-1][filled]]
    last[ends[1:][filled] - 1] = inside[ends[1:][filled] - 1]
    starts = np.flatnonzero(first)
    borders = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(data[inside])])
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends))), words


def word_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """Matrix of word counts per bucket, one row per text.

    Each distinct word of a batch is looked up once.
    """
    owner, words = _words(texts)
    coded = words.dictionary_encode()
    buckets = (_hashes(coded.dictionary) % dim)[coded.indices.to_numpy()]
    return np.bincount(owner * dim + buckets, minlength=len(texts) * dim).reshape(len(texts), dim)


@dataclass(frozen=True)
class HashedTfIdf:
    """Factory of the default embedder; ``weights`` has one value per bucket."""

    weights: tuple[float, ...]

    @property
    def name(self) -> str:
        return f"hashed-tfidf-{len(self.weights)}"

    @property
    def fingerprint(self) -> str:
        """Tells fits of one width from one another."""
        return hashlib.sha256(np.array(self.weights, "<f8").tobytes()).hexdigest()

    def __call__(self) -> BatchFunction:
        weights = np.array(self.weights)

        def embed(texts: pa.Array) -> np.ndarray:
            weighted = word_counts(texts, len(weights)) * weights
            length = np.sqrt((weighted * weighted).sum(axis=1, keepdims=True))
            return weighted / np.where(length == 0, 1.0, length)

        return embed


def fit_hashed_tfidf(texts: DataFrame, text_col: str = "text", dim: int = EMBED_DIM) -> HashedTfIdf:
    """Fit bucket weights ln((N + 1) / (df + 1)) in one pass over ``texts``.

    Each task adds up its document frequencies and emits one array; only ``dim`` sums and
    a count reach the driver, however many texts there are.
    """

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(dim, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, FIT_ROWS):
                counts = word_counts(batch.column(0).slice(at, FIT_ROWS), dim)
                total += (counts > 0).sum(axis=0)
            seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(np.arange(-1, dim, dtype=np.int32)),
                "n": pa.array(np.concatenate(([seen], total))),
            })

    sums = (
        texts.select(text_col).where(F.col(text_col).isNotNull())
        .mapInArrow(frequencies, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    found = {row["bucket"]: row["n"] for row in sums.collect()}
    n_texts = found.get(-1, 0)
    return HashedTfIdf(tuple(
        float(np.log((n_texts + 1.0) / (found.get(bucket, 0) + 1.0))) for bucket in range(dim)
    ))


def embedding(text: Column, factory: Callable[[], BatchFunction], batch_size: int = 1024) -> Column:
    """Vector of each text. The model is built once per task and fed ``batch_size`` texts."""

    @F.arrow_udf(_VECTOR)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for batch in batches:
            texts = pc.fill_null(batch, "")
            parts = [
                np.ascontiguousarray(model(texts.slice(at, batch_size)), dtype=np.float32)
                for at in range(0, len(texts), batch_size)
            ]
            width = parts[0].shape[1] if parts else 0
            values = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * width
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return embed(text)


def embed_text(
    df: DataFrame,
    factory: Callable[[], BatchFunction],
    text_col: str = "text",
    out_col: str = "embedding",
    batch_size: int = 1024,
) -> DataFrame:
    return df.withColumn(out_col, embedding(F.col(text_col), factory, batch_size))
