"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, found by diagonal run skipping."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import text_of
from gleaner.llm.token_counts import CUT, byte_alphabet
from gleaner.session import ship_package, stored

# Fixed value: the mark that stands for a space in pieces.
BLANK = "▁"
PLAIN_CHARS = 200_000  # longer texts are encoded by the library that needs no stack for them
BATCH_CHARS = 1 << 20  # texts aligned together
FIRST_WINDOW = 16  # ends compared at first where one-to-one tokens may follow
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>"

_SIDES: dict[int, Sides] = {}
_NAMES: list[str] = []


class ByteLevel:
    """Tokens of a byte-level BPE file of the tokenizers library; strings of special tokens are plain text.

    A vocabulary whose ids ascend with the ranks of its merges is encoded by a faster library with the same result; very long
    texts, and other vocabularies, by the library the file is of.
    """

    def __init__(self, content: str) -> None:
        told = json.loads(content)
        self.content, self.tokenizer = content, None
        alphabet = byte_alphabet()
        special = {token["id"] for token in told["added_tokens"]}
        self.bytes = {number: bytes(alphabet[sign] for sign in entry)
                      for entry, number in told["model"]["vocab"].items() if number not in special}
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in told["model"]["merges"]]
        numbers = [told["model"]["vocab"][left + right] for left, right in merges]
        self.fast = None
        if numbers == sorted(numbers) and told["normalizer"] is None and told["pre_tokenizer"]["type"] == "ByteLevel" \
                and told["pre_tokenizer"]["use_regex"] and not told["pre_tokenizer"]["add_prefix_space"] \
                and len(numbers) + 256 == len(self.bytes):
            self.fast = tiktoken.Encoding("own", pat_str=CUT, special_tokens={},
                                          mergeable_ranks={own: number for number, own in self.bytes.items()})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or len(text) > PLAIN_CHARS:
            if self.tokenizer is None:
                self.tokenizer = Tokenizer.from_str(self.content)
                self.tokenizer.encode_special_tokens = True
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """Tokens of a sentencepiece model; its bytes stand for themselves, its blank mark for a space."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = {}
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            if self.model.is_byte(number):
                self.bytes[number] = bytes([int(piece[3:5], 16)])
            elif not self.model.is_control(number) and not self.model.is_unknown(number):
                self.bytes[number] = piece.replace(BLANK, " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def common_stops(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of both sides that end at the same byte, given the ascending ends of all tokens.

    Both lists end at the same byte. From a common border the ends are compared at the current shift of positions, in
    windows that double: a stretch of one-to-one tokens is jumped in steps that grow with its logarithm. Where it breaks, the side that
    lags steps on until both ends meet again, which closes one irregular group and gives the new shift.
    """
    a_bytes, b_bytes = a_ends.astype("<i8").tobytes(), b_ends.astype("<i8").tobytes()
    a, b = memoryview(a_ends), memoryview(b_ends)
    n, m = len(a), len(b)
    number = int.from_bytes
    starts: list[int] = []
    shifts: list[int] = []
    lengths: list[int] = []
    i = j = 0
    while i < n:
        left, right = a[i], b[j]
        while left != right:
            if left < right:
                i += 1
                left = a[i]
            else:
                j += 1
                right = b[j]
        # Tokens i and j close a group; those behind them may go on one to one.
        first, shift, window = i, j - i, FIRST_WINDOW
        i += 1
        while (most := min(n, m - shift) - i) > 0:
            width = min(window, most)
            j = i + shift
            unlike = number(a_bytes[8 * i:8 * (i + width)], "little") ^ number(b_bytes[8 * j:8 * (j + width)], "little")
            if unlike:
                i += (unlike & -unlike).bit_length() - 1 >> 6  # ends alike before the first that differs
                break
            i, window = i + width, 2 * window
        j = i + shift
        starts.append(first)
        shifts.append(shift)
        lengths.append(i - first)
    spans = np.array(lengths, np.int64)
    inner = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
    at_a = np.repeat(np.array(starts, np.int64), spans) + inner
    return at_a, at_a + np.repeat(np.array(shifts, np.int64), spans)


def possible_pairs(a: dict[int, bytes], b: dict[int, bytes]) -> np.ndarray:
    """All pairs of ids that can ever end together, as ascending numbers ``a * width + b`` with the second side's width.

    Of two tokens that end at the same byte the shorter one's bytes end the longer one's, so the vocabularies alone tell
    the pairs: as many as tokens have suffixes, some 324,000 for vocabularies of 50,000 and 32,000. Tables by pair are bounded by
    that number, whatever the corpus.
    """
    one, two, width = defaultdict(list), defaultdict(list), max(b) + 1
    for side, vocabulary in ((one, a), (two, b)):
        for number, own in vocabulary.items():
            side[own].append(number)
    found = {left * width + right for own, lefts in one.items() for at in range(len(own))
             for right in two.get(own[at:], ()) for left in lefts}
    found |= {left * width + right for own, rights in two.items() for at in range(len(own))
              for left in one.get(own[at:], ()) for right in rights}
    return np.array(sorted(found), np.int64)


class Sides:
    """Two tokenizers whose tokens are aligned."""

    def __init__(self, a: str, b: bytes) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.a_bytes, self.b_bytes = ([side.bytes.get(number, b"") for number in range(max(side.bytes) + 1)] for side in (self.a, self.b))
        self.a_size, self.b_size = (np.array(list(map(len, side)), np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None if the text is empty or either side's bytes are not those of the text behind a space."""
        if not text:
            return None
        spaced = " " + text
        a_ids, b_ids, whole = self.a.encode(spaced), self.b.encode(text), spaced.encode()
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != whole or b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
            return None
        return np.array(a_ids, np.int64), np.array(b_ids, np.int64)

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of both sides of each text, and the numbers of leading ids behind which its groups stop."""
        none = np.zeros(0, np.int64)
        coded = [self.encode(text) or (none, none) for text in texts]
        a_all = np.concatenate([none, *[a for a, _ in coded]])
        b_all = np.concatenate([none, *[b for _, b in coded]])
        # The texts behind one another are one problem: the ends of a text are a common border.
        a_at, b_at = common_stops(np.cumsum(self.a_size[a_all]), np.cumsum(self.b_size[b_all]))
        a_from = np.cumsum([0, *[len(a) for a, _ in coded]])
        b_from = np.cumsum([0, *[len(b) for _, b in coded]])
        cuts = np.searchsorted(a_at, a_from)
        return [(a, b, a_at[cuts[k]:cuts[k + 1]] + 1 - a_from[k], b_at[cuts[k]:cuts[k + 1]] + 1 - b_from[k])
                for k, (a, b) in enumerate(coded)]


def _sides(a: str, b: bytes) -> Sides:
    """The worker's two tokenizers; one pair of files is kept."""
    key = hash((a, b))
    if key not in _SIDES:
        _SIDES.clear()
        _SIDES[key] = Sides(a, b)
    return _SIDES[key]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without missing lists, as arrays."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


class Aligner:
    """The files of two tokenizers and their possible pairs on the driver, sent to the tasks (a few MB)."""

    def __init__(self, spark: SparkSession, a: str, b: str) -> None:
        ship_package(spark)
        files = Path(a).read_text(encoding="utf-8"), Path(b).read_bytes()
        vocabularies = ByteLevel(files[0]).bytes, Pieces(files[1]).bytes
        self.keys, self.width = possible_pairs(*vocabularies), max(vocabularies[1]) + 1
        self.files, self.shared_keys = spark.sparkContext.broadcast(files), spark.sparkContext.broadcast(self.keys)

    def aligned(
        self, documents: DataFrame, then: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch, schema: str = ALIGNED,
    ) -> DataFrame:
        """One row per document: doc_id, the ids of both sides, and how many ids each group's end has before it.

        Group g holds the ids from ``a_stops[g - 1]`` to ``a_stops[g]`` and from ``b_stops[g - 1]`` to ``b_stops[g]``. A text that is
        missing, empty, or that either tokenizer changes has empty lists. Rows are aligned where they lie, without a shuffle; repeated
        rows and missing ids are kept, other columns are left out. No token is without bytes, so the two last ids of a group
        are its one link. ``then`` may turn batches of these rows into others, of ``schema``, before they leave the task.
        """
        files = self.files

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides = _sides(*files.value)

            def told(ids: list, texts: list) -> pa.RecordBatch:
                found = sides.align(texts)
                columns = [_lists([row[at] for row in found]) for at in range(4)]
                return then(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns],
                                                       names=["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"]))

            for batch in batches:
                ids, texts, held = [], [], 0
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    ids.append(doc_id.as_py())
                    texts.append(text.as_py())
                    held += len(texts[-1])
                    if held >= BATCH_CHARS:
                        yield told(ids, texts)
                        ids, texts, held = [], [], 0
                if ids:
                    yield told(ids, texts)

        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).mapInArrow(run, schema)

    def linked(self, documents: DataFrame) -> DataFrame:
        """Per document the numbers of its tokens and groups, the digest of its groups, and its links: the distinct id pairs
        (places among all that can end together) with their numbers."""
        keys, width = self.shared_keys, self.width

        def report(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(zip(*[_rows(batch.column(at)) for at in range(1, 5)]))
            pairs = [np.unique(np.searchsorted(keys.value, a[a_at - 1].astype(np.int64) * width + b[b_at - 1]), return_counts=True)
                     for a, b, a_at, b_at in rows]
            sizes = [pa.array([len(row[at]) for row in rows], pa.int64()) for at in range(4)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *sizes, pa.array([groups_digest(*row) for row in rows], pa.string()), *[_lists([row[at] for row in pairs]) for at in range(2)]],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        return self.aligned(documents, report, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                               "pairs array<int>, times array<int>")

    def pair_counts(self, linked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Links of the whole corpus per id pair, and whether that is the most of its second id (ties included).

        Tasks add up in place and emit each pair once; as many numbers as there are possible pairs reach the driver at most.
        """
        size = len(self.keys)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for batch in batches:
                places = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                times = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                total += np.bincount(places, weights=times, minlength=size).astype(np.int64)
            filled = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(total[filled])], names=["pair", "n"])

        sums = linked.select("pairs", "times").mapInArrow(add, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        counts, most, b_of = np.zeros(size, np.int64), np.zeros(self.width, np.int64), self.keys % self.width
        counts[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
        np.maximum.at(most, b_of, counts)
        return counts, (counts > 0) & (counts == most[b_of])


def groups_digest(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> str:
    """SHA-256 of the groups of an aligned text as ``a1,a2|b1;a3|b2,b3``: decimal ids in order; empty for a text without tokens."""
    if not len(a):
        return ""
    # Each id is followed by a comma, the last of a group's side by the mark behind that side.
    a_size, b_size = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
    a_place = np.arange(len(a)) + np.repeat(b_stops - b_size, a_size)
    b_place = np.arange(len(b)) + np.repeat(a_stops, b_size)
    width = len(_NAMES) // 3
    if (most := max(int(a.max()), int(b.max()))) >= width:
        width = max(most + 1, 1 << 16)
        _NAMES[:] = [f"{number}{mark}" for mark in ",|;" for number in range(width)]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[a_place], ids[b_place] = a, b
    ids[a_place[a_stops - 1]] += width
    ids[b_place[b_stops - 1]] += 2 * width
    return hashlib.sha256("".join([_NAMES[number] for number in ids.tolist()])[:-1].encode()).hexdigest()


def _link_sums(spark: SparkSession, counts: np.ndarray, best: np.ndarray) -> Column:
    """Of a text's links: how many are the best of their second id, and the sum of their corpus-wide counts."""
    shared = spark.sparkContext.broadcast((counts, best))

    @F.arrow_udf("struct<n_best long, count_sum long>")
    def sums(pairs: pa.Array, times: pa.Array) -> pa.Array:
        counts, best = shared.value
        places = pairs.flatten().to_numpy(zero_copy_only=False)
        number = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))])
        columns = []
        for values in (number * best[places], number * counts[places]):
            running = np.concatenate([[0], np.cumsum(values)])
            columns.append(pa.array(running[ends[1:]] - running[ends[:-1]]))
        return pa.StructArray.from_arrays(columns, names=["n_best", "count_sum"])

    return sums(F.col("pairs"), F.col("times"))


def alignment_report(documents: DataFrame, a: str, b: str) -> DataFrame:
    """Per document its tokens, groups and links, and what the links weigh in the whole corpus.

    ``count_sum`` adds up, over the links, how many links of the corpus join the same two ids; ``n_best`` counts the links whose
    ids are joined as often as any id is joined to that second id. Documents are encoded and aligned once; what is kept for
    the second look are the distinct pairs of each and their numbers. Missing and empty texts, and texts that a
    tokenizer changes, have zeros and an empty digest.
    """
    aligner = Aligner(documents.sparkSession, a, b)
    linked = stored(aligner.linked(documents), "links")
    weighed = linked.withColumn("sums", _link_sums(documents.sparkSession, *aligner.pair_counts(linked)))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "sums.n_best", "sums.count_sum", "groups_sha256")
