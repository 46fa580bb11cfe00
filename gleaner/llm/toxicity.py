"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import drawn, text_of
from gleaner.session import stored

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 20
PREFIXES = (4, 5)
GRADES = 4
SCORE = "expected_severity double, p_toxic double, severity int"


def features_of(word: str) -> list[int]:
    """Hashed features of a lower-case word: the word and its first letters."""
    keys = [f"w{word}"] + [f"p{word[:size]}" for size in PREFIXES if len(word) >= size]
    return [zlib.crc32(key.encode()) >> (32 - BITS) for key in keys]


def text_features(text: str) -> list[int]:
    """Distinct hashed features of a whole text."""
    return sorted({key for word in set(LETTERS.findall(text.lower())) for key in features_of(word)})


@dataclass(frozen=True)
class SeverityModel:
    """Shared weights by feature and ascending thresholds: P(grade <= k) = sigmoid(threshold_k - w.x)."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def grades(self, margins: np.ndarray) -> np.ndarray:
        """Probability of each grade, one row per margin w.x."""
        below = 1 / (1 + np.exp(-np.clip(np.array(self.thresholds)[None, :] - margins[:, None], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(margins), 1)), below, np.ones((len(margins), 1))]), axis=1)


def ordinal_fit(
    rows: list[np.ndarray], grades: np.ndarray, width: int, steps: int = 400, rate: float = 0.1, prior: float = 0.4,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood; ``rows`` holds column numbers.

    ``prior`` is the weight of a normal prior, which counts less the more rows there are.
    """
    decay = prior / max(1, len(rows)) + 1.5e-4
    lengths = np.array([len(row) for row in rows])
    columns = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    levels = GRADES - 1
    share = np.clip(np.array([(grades <= level).mean() for level in range(levels)]), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(levels))
    # Parameters: weights, first threshold, logarithms of the gaps.
    state = np.concatenate([np.zeros(width), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        weights, gaps = state[:width], np.exp(state[width + 1:])
        cuts = state[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        margin = np.bincount(owner, weights=weights[columns], minlength=len(rows))
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - margin[:, None], -30, 30)))
        full = np.hstack([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))])
        slope = full * (1 - full)
        at = np.arange(len(rows))
        upper, lower = slope[at, grades + 1], slope[at, grades]
        chance = np.maximum(full[at, grades + 1] - full[at, grades], 1e-9)
        pull = (upper - lower) / chance / len(rows)  # minus the derivative by the cut, both ends moved
        into = np.zeros((len(rows), levels + 2))
        into[at, grades + 1] += upper / chance / len(rows)
        into[at, grades] -= lower / chance / len(rows)
        by_cut = into[:, 1:-1].sum(axis=0)
        gradient = np.concatenate([
            np.bincount(columns, weights=pull[owner], minlength=width) + decay * weights,
            [-by_cut.sum()], -np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return state[:width], state[width] + np.concatenate([[0.0], np.cumsum(np.exp(state[width + 1:]))])


def fit_severity(
    documents: DataFrame, labels: DataFrame, sample_rows: int = 8_000, max_features: int = 20_000,
    least_z: float = 2.5, cuts: tuple[int, int] = (2, 5),
) -> SeverityModel:
    """Fit on a bounded sample of the labelled rows (``sample_rows`` expected, by hash of doc_id).

    ``labels`` (doc_id, toxic) says toxic or not only. A toxic document has grade 1, 2 or 3 by
    the number of its tell-tale features, those much more frequent in toxic documents:
    up to ``cuts[0]``, up to ``cuts[1]``, or more. Rows with a missing id or label are left
    out; of several labels of one id the highest counts. Without toxic or clean rows the
    model calls nothing toxic.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    draw = drawn(F.col("doc_id"), sample_rows / max(1, known.count()))
    chosen = known.filter(draw)  # about sample_rows rows of two numbers

    @F.arrow_udf("array<int>")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([text_features(text or "") for text in batch.to_pylist()], pa.list_(pa.int32()))

    sample = stored(
        documents.filter(draw).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .select("toxic", features(text_of(F.col("text"))).alias("features")), "severity-sample")
    totals = {row["toxic"] > 0: row["n"] for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(False, 0), totals.get(True, 0)
    if not clean or not toxic:
        return SeverityModel({}, (30.0, 31.0, 32.0))
    hits = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("c"))
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    scored = hits.withColumn("z", ratio / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    kept = scored.filter((F.abs("z") >= least_z) & (F.col("t") + F.col("c") >= 2)).orderBy(
        F.abs("z").desc(), "feature").limit(max_features).collect()
    place = {row["feature"]: at for at, row in enumerate(kept)}
    telling = {row["feature"] for row in kept if row["t"] > 20 * row["c"] * toxic / clean and row["t"] >= 2}

    @F.arrow_udf("array<int>")
    def screened(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[key for key in keys if key in place] for keys in batch.to_pylist()], pa.list_(pa.int32()))

    wanted = sample.select("toxic", screened("features").alias("features"))
    rows, grades = [], []
    for row in wanted.toLocalIterator():
        rows.append(np.array([place[key] for key in row["features"]], np.int64))
        found = sum(key in telling for key in row["features"])
        grades.append(0 if row["toxic"] <= 0 else 1 + (found > cuts[0]) + (found > cuts[1]))
    weights, thresholds = ordinal_fit(rows, np.array(grades), len(place))
    return SeverityModel({key: float(weights[at]) for key, at in place.items()}, tuple(map(float, thresholds)))


def severity(text: Column, model: SeverityModel) -> Column:
    """Struct of expected severity (0 to 3), probability of any toxicity and likeliest grade.

    Reads the whole text, however long; a missing text counts as empty. Rows are scored one by one,
    so repeated rows get equal scores.
    """
    weights = model.weights

    @F.arrow_udf(SCORE)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            margins = []
            for text in batch.to_pylist():
                found: set[int] = set()
                for word in set(LETTERS.findall((text or "").lower())):
                    keys = seen.get(word)
                    if keys is None:
                        if len(seen) > 200_000:  # a cache of words, nothing depends on it
                            seen.clear()
                        keys = seen[word] = [key for key in features_of(word) if key in weights]
                    found.update(keys)
                margins.append(sum(weights[key] for key in sorted(found)))
            chances = model.grades(np.array(margins, float).reshape(-1))
            yield pa.StructArray.from_arrays([
                pa.array(chances @ np.arange(GRADES)), pa.array(1 - chances[:, 0]),
                pa.array(chances.argmax(axis=1).astype(np.int32)),
            ], names=["expected_severity", "p_toxic", "severity"])

    return score(text_of(text))


def reject_toxic(documents: DataFrame, model: SeverityModel, least: float = 0.5) -> DataFrame:
    """Rows that are more likely clean (grade 0) than not, with the columns of ``documents``."""
    return documents.filter(severity(F.col("text"), model)["p_toxic"] < least)
