"""Token counts: byte-pair merging of whole texts with a heap and a linked list, without ids."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm.common import text_of
from gleaner.session import ship_package

# Fixed value: how byte-level tokenizers cut a text before they merge.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN_PIECES = 1 << 18  # counts a worker remembers before it starts anew
KNOWN_CHARS = 64  # longer pieces are merged each time

_COUNTERS: dict[int, MergeCounter] = {}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 signs stand for themselves,
    the others, in order, for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(rest)}


def _assigned(text: str) -> bool:
    """Whether all characters are old enough for libraries to agree on what they are."""
    return text.isascii() or not any(unicodedata.category(sign) == "Cn" for sign in set(text))


class MergeCounter:
    """Number of tokens of texts, as the tokenizer of a byte-level BPE file gives them.

    A text is cut into added tokens and pieces; a text with characters unknown to this Python's Unicode tables is cut by the
    tokenizer itself. What a piece comes to is counted here, on its bytes.
    """

    def __init__(self, content: str) -> None:
        told = json.loads(content)
        model = told["model"]
        if model["type"] != "BPE" or (told["pre_tokenizer"] or {}).get("type") != "ByteLevel" or told["normalizer"]:
            raise ValueError("only byte-level BPE files without a normalizer are counted")
        if model.get("ignore_merges") or model.get("dropout") or any(
                token[flag] for token in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("dropout, ignored merges and added tokens that take their surroundings are not supported")
        if not told["pre_tokenizer"]["use_regex"] or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only texts cut by the usual pattern, without a space put before them, are counted")
        alphabet = byte_alphabet()
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.ranks = {tuple(bytes(alphabet[sign] for sign in side) for side in pair): rank for rank, pair in enumerate(merges)}
        self.bytes = [bytes([byte]) for byte in range(256)]
        self.own_cut = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
        self.cut = regex.compile(CUT).findall
        added = sorted((token["content"] for token in told["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Symbols left of a piece: pairs are merged by rank, equal ranks from the left, until none has a rank."""
        left = len(piece)
        if left < 2:
            return left
        ranks, symbols = self.ranks, [self.bytes[byte] for byte in piece]
        after, before = list(range(1, left + 1)), list(range(-1, left - 1))
        end = left
        heap = [(rank, at) for at in range(end - 1)
                if (rank := ranks.get((symbols[at], symbols[at + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            # A merge nearby may have taken or changed one of the two.
            if symbols[at] is None or right == end or ranks.get((symbols[at], symbols[right])) != rank:
                continue
            symbols[at] += symbols[right]
            symbols[right] = None
            follower = after[at] = after[right]
            left -= 1
            if follower < end:
                before[follower] = at
                if (rank := ranks.get((symbols[at], symbols[follower]))) is not None:
                    heapq.heappush(heap, (rank, at))
            leader = before[at]
            if leader >= 0 and (rank := ranks.get((symbols[leader], symbols[at]))) is not None:
                heapq.heappush(heap, (rank, leader))
        return left

    def _plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        total, known = 0, self.known
        pieces = self.cut(text) if _assigned(text) else [text[begin:end] for _, (begin, end) in self.own_cut(text)]
        for piece in pieces:
            count = known.get(piece)
            if count is None:
                count = self.merged(piece.encode())
                if len(piece) <= KNOWN_CHARS:
                    if len(known) >= KNOWN_PIECES:
                        known.clear()
                    known[piece] = count
            total += count
        return total

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _counter(content: str) -> MergeCounter:
    """The worker's counter of a tokenizer file; one is kept."""
    key = hash(content)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = MergeCounter(content)
    return _COUNTERS[key]


def token_count(spark: SparkSession, text: Column, tokenizer: str) -> Column:
    """Number of tokens of each whole text (long) by a tokenizer file, without begin, end or other added ids.

    ``tokenizer`` is a byte-level BPE file of the tokenizers library, read on the driver and sent along (a few MB).
    Strings of its special tokens inside a text count as one token each, which is that library's default. A missing or
    empty text has no tokens; ties of rank go to the left; a very long text or piece takes n log n steps and memory of its own
    size. Rows are counted one by one, so that repeated rows, missing ids and other columns make no difference.
    """
    ship_package(spark)
    content = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(content.value)
        for batch in batches:
            yield pa.array([counter.count(text.as_py()) for text in batch], pa.int64())

    return count(text_of(text))
