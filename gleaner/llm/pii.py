"""PII: overlapping candidates, gradient-boosted trees and calibrated thresholds.

Base formats are always spans. The trees judge what the generators propose beyond them; they learn from base spans written anew in
looser forms, against look-alikes.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import drawn, text_of

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,chance:double>>"

WRITINGS = 3  # times that each base span is written anew for training

# The base formats. An address is found from its @; the others begin where no digit run goes on.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# High-recall generators: other writings of the same kinds, bounded in length.
_LOOSE = {
    "email": re.compile(
        r"(?<![\w.%+-])[\w.%+-]{1,64}(?:\s?(?:@|\(at\)|\[at\])\s?)[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,4}(?:\s?\.\s?[0-9]{1,4}){3}(?![\w.]*\w)"),
    "card": re.compile(r"(?<![\w-])[0-9](?:[\x20.-]?[0-9]){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+-])\+?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![\w-])"),
}
_TELLING = {
    "email": ("mail", "e-mail", "contact", "write"), "ip": ("ip", "host", "address", "from"),
    "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}
_ENDINGS = ("com", "org", "net", "edu", "io", "de", "fr", "es")
_AT, _DOT = re.compile(r"[(\[]at[)\]]", re.I), re.compile(r"[(\[]dot[)\]]", re.I)
_LABEL = re.compile(r"[\w-]*$")
_OTHER = ("version", "v", "no", "nr", "id", "order", "isbn", "section", "page", "token", "license")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base formats by kind, then start; leftmost, not overlapping within a kind, failing ones dropped.

    Takes time linear in the text.
    """
    out, free = [], 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            out.append(("email", start, match.end()))
            free = match.end()
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") for part in match.group().split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            out.append(("ip", match.start(), match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group()) if match.end() - match.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", match.start(), match.end()))
    for match in _PHONE.finditer(text):
        if 8 <= len(_digits(match.group())) <= 15:
            out.append(("phone", match.start(), match.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposals of the generators; spans of different kinds may overlap.

    They propose local parts of up to 64 characters, domains of up to five labels, numbers of 13 to 19 digits and phones
    of up to six groups; longer writings are found by the base formats alone.
    """
    digits = any(digit in text for digit in "0123456789")
    small = text.lower()
    mail = any(sign in small for sign in ("@", "at)", "at]"))
    found = []
    for kind, pattern in _LOOSE.items():
        if mail if kind == "email" else digits:
            found += [(kind, match.start(), match.end()) for match in pattern.finditer(text)]
    return found


class Covered:
    """Stretches of a text that spans cover, in order and apart: a look-up takes logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """Cover one more stretch, which meets none so far."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def span_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    digits = _digits(span)
    words = re.findall(r"\w+", before.lower())
    groups = [len(group) for group in re.findall(r"[0-9]+", span)]
    parts = [int(group) for group in re.findall(r"[0-9]+", span) if len(group) < 5]
    return [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(groups)), float(max(groups, default=0)),
        float(min(groups, default=0)), float(max(parts, default=0)), float(span.startswith("+")), float("(" in span),
        float(span.count(".")), float(span.count("-")), float(span.count(" ")), float("@" in span),
        float(luhn(digits) if digits else 0), float(len(set(digits))),
        float(len(_LABEL.search(span).group())), float(bool(_AT.search(span))), float(bool(_DOT.search(span))), float(any(word in _TELLING[kind] for word in words[-3:])),
        float(any(word in _OTHER for word in words[-2:])), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(sum(c.isdigit() for c in before)), float(sum(c.isdigit() for c in after)),
    ]


@dataclass(frozen=True)
class SpanModel:
    """Trees as (feature, edge, left, right) or leaves, scores to chances by ``slope`` and ``shift``, a threshold by kind."""

    trees: tuple
    slope: float
    shift: float
    thresholds: dict[str, float]

    def chances(self, x: np.ndarray) -> np.ndarray:
        score = sum((_predict(tree, x) for tree in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    feature, edge, left, right = tree
    return np.where(x[:, feature] <= edge, _predict(left, x), _predict(right, x))


def _edges(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    """Places where each feature may be cut: its values, or their quantiles if it has many."""
    found = []
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        if len(values) > most:
            values = np.unique(np.quantile(x[:, feature], np.linspace(0, 1, most), method="lower"))
        found.append(values[:-1])
    return found


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray, depth: int):
    """A tree of second-order boosting; ``bins`` holds the number of edges below each value."""
    g_all, h_all = gradient.sum(), curve.sum()
    leaf = float(-0.3 * g_all / (h_all + 1.0))
    if not depth or len(x) < 8:
        return leaf
    best, choice = 1e-3, None
    for feature, own in enumerate(edges):
        if not len(own):
            continue
        size = len(own) + 1
        g, h, n = (np.bincount(bins[:, feature], weights, size).cumsum()[:-1] for weights in (gradient, curve, None))
        gain = g * g / (h + 1.0) + (g_all - g) ** 2 / (h_all - h + 1.0) - g_all ** 2 / (h_all + 1.0)
        gain[(n < 4) | (n > len(x) - 4)] = 0.0
        at = int(gain.argmax())
        if gain[at] > best:
            best, choice = gain[at], (feature, at)
    if choice is None:
        return leaf
    feature, at = choice
    low = bins[:, feature] <= at
    return (feature, float(edges[feature][at]), _grow(x[low], bins[low], edges, gradient[low], curve[low], depth - 1),
            _grow(x[~low], bins[~low], edges, gradient[~low], curve[~low], depth - 1))


def boosted_fit(
    x: np.ndarray, y: np.ndarray, back: np.ndarray, rounds: int = 60, depth: int = 4, precision: float = 0.98,
) -> SpanModel:
    """Boosting on the rows that are not held ``back``; those calibrate chances (logistic) and the thresholds.

    The threshold of a kind is the lowest chance, one half at least, from which on ``precision`` of the held-back rows are right,
    of at least 20 rows; a kind without such a place adds nothing.
    """
    score, trees = np.zeros(len(y)), []
    edges = _edges(x[~back])
    bins = np.stack([np.searchsorted(own, x[~back][:, feature]) for feature, own in enumerate(edges)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        tree = _grow(x[~back], bins, edges, (p - y)[~back], (p * (1 - p))[~back], depth)
        trees.append(tree)
        score = score + _predict(tree, x)
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * score[back] + shift, -30, 30)))
        error, curve = p - y[back], p * (1 - p) + 1e-3
        slope -= float((error * score[back]).sum() + 1e-2 * (slope - 1)) / float((curve * score[back] ** 2).sum() + 1.0)
        shift -= float(error.sum()) / float(curve.sum() + 1.0)
    model = SpanModel(tuple(trees), slope, shift, {})
    chance, thresholds = model.chances(x[back]), {}
    for number, kind in enumerate(KINDS):
        own = x[back][:, 0] == number
        for edge in sorted(set(chance[own & (chance >= 0.5)])):
            above = own & (chance >= edge)
            if above.sum() >= 20 and y[back][above].mean() >= precision:
                thresholds[kind] = float(edge)
                break
    return SpanModel(model.trees, slope, shift, thresholds)


def _check_digit(digits: str) -> str:
    return next(d for d in "0123456789" if luhn(digits + d))


def rewritings(kind: str, span: str, rng: random.Random, words: list[str]) -> list[tuple[str, str, bool]]:
    """Loose writings of a base span, and look-alikes of the same shape: (words before, writing, right).

    None of them is of a base format. What tells them apart is their validity (Luhn, parts of an address), their grouping or the
    word before: a number of plain groups is a phone behind "call" and none behind "order".
    """
    told, other = rng.choice(_TELLING[kind]) + " ", rng.choice(_OTHER) + " "
    plain = rng.choice(["", told])
    digits = _digits(span)
    if kind == "email":
        names = [word.strip(".,") for word in words if word.strip(".,").isalpha()] or ["so"]
        name, place, then = (rng.choice(names) for _ in range(3))
        local, _, domain = span.partition("@")
        local = rng.choice([local, name, f"{name}.{then}"])
        domain = rng.choice([domain, f"{place}.{rng.choice(_ENDINGS)}", f"{then}.{place}.{rng.choice(_ENDINGS)}"])
        dot = rng.choice([" (dot) ", " [dot] ", "(dot)", "."])
        at = rng.choice([" (at) ", " [at] ", "(at)", "[at]"])
        hidden = local + at + dot.join(domain.split("."))
        return [(plain, rng.choice([hidden, hidden.upper()]), True), (told, " @ ".join([local, domain]), True),
                ("", f"{name} @ {place}. {then}", False), (other, f"{name} @ {place}. {then}. {name}", False)]
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        gap = rng.choice([" . ", ". ", " ."])
        big = [*parts[:3], str(rng.randint(256, 9999))]
        rng.shuffle(big)
        return [(told, gap.join(parts), True), ("", gap.join(big), False), (told, gap.join(big), False),
                (other, gap.join(str(rng.randint(0, 12)) for _ in range(4)), False)]
    if kind == "card":
        short = digits[:rng.choice([12, 13, 14])]
        short += _check_digit(short)
        wrong = short[:-1] + str((int(short[-1]) + rng.randint(1, 9)) % 10)
        dotted = ".".join(digits[at:at + 4] for at in range(0, len(digits), 4))
        last = str((int(dotted[-1]) + rng.randint(1, 9)) % 10)
        return [(told, short, True), (plain, dotted, True), (told, wrong, False), ("", wrong, False), (other, short, False),
                (plain, dotted[:-1] + last, False)]
    own = digits[-10:]
    sep = rng.choice(["-", ".", " "])
    groups = [own[:3], own[3:6], own[6:]]
    date = f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    amount = rng.choice([" ", "."]).join([str(rng.randint(1, 999)), *(f"{rng.randint(0, 999):03d}" for _ in range(rng.randint(1, 3)))])
    return [(plain, f"({groups[0]}) {groups[1]}-{groups[2]}", True), (told, sep.join(groups), True), (other, sep.join(groups), False),
            ("", date, False), ("", amount, False), (told, "/".join([own[:2], own[2:4]]), False)]


def training_rows(text: str) -> Iterator[tuple[list[float], bool]]:
    """Features and labels of candidates that no base span meets, as :func:`spans_of` will judge them.

    Each base span is written anew in place (:func:`rewritings`); what the generators propose there carries the writing's label if
    it covers it, and is wrong if it covers a part only. Candidates of the text as it is, outside base spans, are wrong unless a telling word stands
    before them: then nothing is known, and they are left out. The draws depend on the text alone.
    """
    rng = random.Random(zlib.crc32(text.encode()))
    base = base_spans(text)
    covered = Covered((start, end) for _, start, end in base)
    for kind, start, end in candidates(text):
        if not covered.meets(start, end):
            before = re.findall(r"\w+", text[max(0, start - 24):start].lower())[-3:]
            if not any(word in _TELLING[kind] for word in before):
                yield span_features(text, kind, start, end), False
    for kind, start, end in base:
        before, after = text[max(0, start - 200):start], text[end:end + 200]
        words = before.split() + after.split()
        for lead, writing, right in [row for _ in range(WRITINGS) for row in rewritings(kind, text[start:end], rng, words)]:
            if before and not before[-1].isspace():
                lead = " " + lead
            whole = before + lead + writing + after
            at, to = len(before + lead), len(before + lead + writing)
            if any(s < to and at < e for _, s, e in base_spans(whole)):
                continue
            for name, s, e in candidates(whole):
                if name == kind and s < to and at < e:
                    yield span_features(whole, kind, s, e), right and s <= at and e >= to


def fit_spans(documents: DataFrame, sample_rows: int = 8_000) -> SpanModel:
    """Fit on the candidates of a bounded sample of documents (``sample_rows`` expected, by hash of doc_id).

    Every row is outside the base formats (:func:`training_rows`), so that the trees and thresholds are told what they judge. A quarter
    of the texts is held back for calibration. A sample without base spans teaches nothing, and
    nothing is added then. Rows without an id are not learned from.
    """
    share = sample_rows / max(1, documents.count())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                told = list(training_rows(text))
                if told:
                    back = zlib.crc32(text.encode()) % 4 == 3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x, _ in told], pa.list_(pa.float64())), pa.array([y for _, y in told], pa.bool_()),
                         pa.array([back] * len(told), pa.bool_())], names=["x", "y", "back"])

    chosen = documents.filter(drawn(F.col("doc_id"), share))
    rows = sorted(tuple(row) for row in chosen.select(text_of(F.col("text")).alias("text")).mapInArrow(
        encode, "x array<double>, y boolean, back boolean").collect())
    x = np.array([row[0] for row in rows], float)
    y = np.array([row[1] for row in rows], float)
    back = np.array([row[2] for row in rows], bool)
    if len(y) < 40 or y.min() == y.max() or back.all() or not back.any():
        return SpanModel((), 1.0, -30.0, {})
    return boosted_fit(x, y, back)


def spans_of(text: str, model: SpanModel) -> list[tuple[str, int, int, bool, float]]:
    """Base spans, and candidates above their kind's threshold that overlap no chosen span; by kind, then start."""
    chosen = [(kind, start, end, True, 1.0) for kind, start, end in base_spans(text)]
    if model.thresholds:
        covered = Covered((start, end) for _, start, end, _, _ in chosen)
        proposed = [c for c in candidates(text) if not covered.meets(c[1], c[2])]
        if proposed:
            chance = model.chances(np.array([span_features(text, *c) for c in proposed]))
            for at in np.argsort(-chance, kind="stable"):
                kind, start, end = proposed[at]
                if chance[at] >= model.thresholds.get(kind, 2.0) and not covered.meets(start, end):
                    covered.add(start, end)
                    chosen.append((kind, start, end, False, float(chance[at])))
    return sorted(chosen, key=lambda span: (KINDS.index(span[0]), span[1]))


def personal_spans(text: Column, model: SpanModel) -> Column:
    """Spans of a whole text, ends exclusive, in code points; none for an empty or missing text."""

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("base", pa.bool_()), ("chance", pa.float64())]))
        names = ("kind", "start", "end", "base", "chance")
        for batch in batches:
            yield pa.array([[dict(zip(names, span)) for span in spans_of(text or "", model)]
                            for text in batch.to_pylist()], kind)

    return find(text_of(text))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""

    @F.arrow_udf("string")
    def redact(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for whole, own in zip(texts.to_pylist(), found.to_pylist()):
                parts, at = [], 0
                for span in sorted(own or [], key=lambda span: (span["start"], -span["end"])):
                    if span["start"] >= at:
                        parts += [whole[at:span["start"]], f"[{span['kind']}]"]
                    at = max(at, span["end"])
                out.append("".join(parts) + whole[at:])
            yield pa.array(out, pa.string())

    return redact(text_of(text), spans)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))), ",")
