"""Quality classifier: attention-based multiple-instance learning over all passages of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import drawn, text_of

PASSAGE = 96  # words
CHUNK = 400_000  # characters that are encoded together
LOWER, UPPER, DIGIT, STOP, SHOUT, BAR, SYMBOL, OTHER, LINE, BLANK = range(10)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for low, high, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT), ("!", "~", None)):
        if kind is not None:
            kinds[ord(low):ord(high) + 1] = kind
    for marks, kind in ((".,;:?'\"()-", STOP), ("!", SHOUT), ("|", BAR), ("#$%&*@^~<>=+_/\\{}[]`", SYMBOL),
                        ("\n", LINE), (" \t\x0b\x0c\r", BLANK)):
        for mark in marks:
            kinds[ord(mark)] = kind
    return kinds


CLASSES = _classes()
POWERS = np.random.default_rng(7).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WIDTH = 17


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text.

    A passage is a run of ``PASSAGE`` words; a text without words has one passage of zeros.
    """
    parts, counts, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        features, number = _encode(texts[at:end])
        parts.append(features)
        counts.append(number)
        at = end
    if not parts:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(text) + 1 for text in texts])
    begins = np.cumsum(lengths) - lengths
    kinds = np.where(codes < 256, CLASSES[np.minimum(codes, 255)], OTHER).astype(np.uint8)
    inside = kinds < LINE
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(begins, starts, "right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    number = np.maximum(1, -(-per_doc // PASSAGE))
    base = np.cumsum(number) - number
    out = np.zeros((int(number.sum()), WIDTH), np.float32)
    if not len(starts):
        return out, number
    rank = np.arange(len(starts)) - (np.cumsum(per_doc) - per_doc)[doc]
    passage = base[doc] + rank // PASSAGE
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    which = passage[heads]
    words = np.diff(np.append(heads, len(starts))).astype(float)
    first, last = starts[heads], np.append(stops[heads[1:] - 1], stops[-1])
    span = (last - first).astype(float)
    for kind in range(9):
        total = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int32)])
        out[which, kind] = (total[last] - total[first]) / span
    size = stops - starts
    # A hash of each word: its characters weighted by place, summed modulo 2**64.
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))).astype(np.int64) \
        if starts[0] == 0 else np.arange(len(codes)) - np.concatenate([
            np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(codes))))])
    mixed = np.where(inside, codes.astype(np.uint64) * POWERS[place % 4096], np.uint64(0))
    hashes = np.add.reduceat(mixed, starts)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    key = hashes * np.uint64(0x9E3779B97F4A7C15) ^ passage.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    fresh = np.zeros(len(key), bool)
    fresh[order] = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    def mean(values):
        return np.add.reduceat(values.astype(float), heads) / words
    out[which, 9] = mean(size) / 10
    out[which, 10] = np.sqrt(np.maximum(0, mean(size.astype(float) ** 2) - mean(size) ** 2)) / 10
    out[which, 11] = mean(same)
    out[which, 12] = mean(fresh)
    out[which, 13] = mean(kinds[starts] == UPPER)
    out[which, 14] = mean(kinds[stops - 1] == STOP)
    out[which, 15] = mean((size == 1) & (kinds[starts] > DIGIT))
    out[which, 16] = np.log1p(words) / 5
    return out, number


@dataclass(frozen=True)
class AttentionModel:
    """tanh encoder, gated attention (tanh times sigmoid) and a logistic head."""

    centre: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]  # encoder, its bias, V, U, attention vector, head, its bias

    def scores(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _forward((features - self.centre) / self.scale, counts, self.weights)["score"]


def _forward(x: np.ndarray, counts: np.ndarray, weights: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
    encoder, bias, v, u, attend, head, shift = weights
    heads = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    hidden = np.tanh(x @ encoder + bias)
    left, right = np.tanh(hidden @ v), 1 / (1 + np.exp(-np.clip(hidden @ u, -30, 30)))
    logit = (left * right) @ attend
    share = np.exp(logit - np.maximum.reduceat(logit, heads)[owner])
    share /= np.add.reduceat(share, heads)[owner]
    pooled = np.add.reduceat(share[:, None] * hidden, heads, axis=0)
    score = 1 / (1 + np.exp(-np.clip(pooled @ head + shift, -30, 30)))
    return {"hidden": hidden, "left": left, "right": right, "share": share, "pooled": pooled, "score": score,
            "owner": owner, "heads": heads}


def attention_fit(
    features: np.ndarray, counts: np.ndarray, labels: np.ndarray, width: int = 16, gates: int = 8,
    steps: int = 250, rate: float = 0.02, decay: float = 1e-4,
) -> AttentionModel:
    """Full-batch Adam on the mean log-loss of document labels."""
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x = (features - centre) / scale
    rng = np.random.default_rng(3)
    weights = [rng.normal(0, 0.3, shape) for shape in
               ((x.shape[1], width), (width,), (width, gates), (width, gates), (gates,), (width,), ())]
    weights[6] = np.array(0.0)
    first, second = [0.0 * w for w in weights], [0.0 * w for w in weights]
    for step in range(1, steps + 1):
        run = _forward(x, counts, tuple(weights))
        owner, hidden, share = run["owner"], run["hidden"], run["share"]
        error = (run["score"] - labels) / len(labels)
        by_pooled = error[:, None] * weights[5]
        by_share = (by_pooled[owner] * hidden).sum(axis=1)
        mean = np.add.reduceat(share * by_share, run["heads"])[owner]
        by_logit = share * (by_share - mean)
        by_gate = by_logit[:, None] * weights[4]
        by_left = by_gate * run["right"] * (1 - run["left"] ** 2)
        by_right = by_gate * run["left"] * run["right"] * (1 - run["right"])
        by_hidden = share[:, None] * by_pooled[owner] + by_left @ weights[2].T + by_right @ weights[3].T
        by_in = by_hidden * (1 - hidden**2)
        gradients = [x.T @ by_in, by_in.sum(axis=0), hidden.T @ by_left, hidden.T @ by_right,
                     (run["left"] * run["right"]).T @ by_logit, run["pooled"].T @ error, error.sum()]
        for at, gradient in enumerate(gradients):
            gradient = gradient + decay * weights[at]
            first[at] = 0.9 * first[at] + 0.1 * gradient
            second[at] = 0.999 * second[at] + 0.001 * gradient**2
            weights[at] = weights[at] - rate * (first[at] / (1 - 0.9**step)) / (
                np.sqrt(second[at] / (1 - 0.999**step)) + 1e-8)
    return AttentionModel(centre, scale, tuple(np.asarray(w) for w in weights))


def is_held_out() -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = 6_000) -> AttentionModel | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    About ``sample_rows`` rows are taken by hash of the id, each with all its passages. Rows with a missing id
    or label are left out; of several labels of an id the highest counts. None if one of the labels is absent.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~is_held_out()).groupBy(
        "doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    draw = drawn(F.col("doc_id"), sample_rows / max(1, known.count()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, counts = passage_features([text or "" for text in batch.column("text").to_pylist()])
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("quality"), pa.array([
                    features[end - count:end].astype("<f4").tobytes() for end, count in zip(ends, counts)],
                    pa.binary())], names=["doc_id", "quality", "passages"])

    chosen = documents.filter(draw & ~is_held_out()).select("doc_id", text_of(F.col("text")).alias("text")).join(
        F.broadcast(known.filter(draw)), "doc_id").select("doc_id", "quality", "text")
    rows = chosen.mapInArrow(encode, "doc_id long, quality int, passages binary").collect()
    rows.sort(key=lambda row: (row["doc_id"], bytes(row["passages"])))
    labels_of = np.array([row["quality"] > 0 for row in rows], float)
    if not len(rows) or labels_of.min() == labels_of.max():
        return None
    bags = [np.frombuffer(row["passages"], "<f4").reshape(-1, WIDTH) for row in rows]
    return attention_fit(np.concatenate(bags).astype(float), np.array([len(bag) for bag in bags]), labels_of)


def quality_score(text: Column, model: AttentionModel | None) -> Column:
    """Probability of label 1 from all passages of the whole text; a missing text counts as empty.

    Without a model (labels of one kind only) every score is one half.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [text or "" for text in batch.to_pylist()]
            if model is None or not texts:
                yield pa.array([0.5] * len(texts), pa.float64())
                continue
            yield pa.array(model.scores(*passage_features(texts)), pa.float64())

    return score(text_of(text))
