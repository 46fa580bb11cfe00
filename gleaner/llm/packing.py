"""Packing: vector bin packing of documents into sequences by the dot-product heuristic."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, small_batches, text_of
from gleaner.session import ship_package

TOKENS = 2048
SEGMENTS = 128
END = 1  # id behind each document
POOL = 512  # open pieces a task chooses from
LEAST_CUT = 16  # room that is worth a cut
TEXTS = 256  # texts taken together
TEXT_BYTES = 1 << 18  # of these, what is encoded at once, one text at least
OUT_TOKENS = 262_144  # ids of pieces told together
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")


def runs(texts: pa.Array, n_bytes: int) -> Iterator[list[str]]:
    """The texts in order, in runs of at most ``n_bytes`` bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + n_bytes, side="right")))
        yield texts.slice(begin, end - begin).to_pylist()
        begin = end


class Packer:
    """Open pieces of one task, put into sequences one after another.

    A sequence has room for tokens, segments and loss-bearing tokens. While some piece fits in all three, the one with the largest
    dot product of its demand and the room left goes in. Room that no piece fits is filled with a cut of the
    largest piece. Full-length parts of long documents are sequences of their own.
    """

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int) -> None:
        self.limits = np.array([tokens, segments, loss], float)
        self.next_id = first_id
        self.open: list[tuple] = []  # (document, start)
        self.size = np.zeros((0, 3))
        self.free: list[tuple[tuple, int, int]] = []

    @staticmethod
    def _loss(document: tuple, start: int, end: int) -> int:
        return max(0, end - max(start, document[2]))

    def add(self, document: tuple) -> Iterator[tuple]:
        """``document``: (doc_id, ids, first token that bears loss). Yields pieces that are placed at once."""
        start, whole = 0, len(document[1])
        tokens = int(self.limits[0])
        while whole - start >= tokens and self._loss(document, start, start + tokens) <= self.limits[2]:
            yield self._piece(document, start, tokens, 0)
            self.next_id += 1
            start += tokens
        while start < whole:  # a rest; several only where loss is the tighter limit
            length = self._longest(document, start, *self.limits[[0, 2]])
            self.free.append((document, start, length))
            start += length

    def _longest(self, document: tuple, start: int, tokens: float, loss: float) -> int:
        return int(min(len(document[1]) - start, tokens, max(0, document[2] - start) + loss))

    def _piece(self, document: tuple, start: int, length: int, offset: int) -> tuple:
        return (document[0], start, length, document[1][start:start + length], len(document[1]),
                self._loss(document, start, start + length), self.next_id, offset)

    def pack(self, until: int) -> Iterator[tuple]:
        """Fill sequences while more than ``until`` pieces are open."""
        items = self.free
        demand = np.array([(length, 1, self._loss(document, start, start + length)) for document, start, length in items],
                          float).reshape(-1, 3)
        weight = demand / self.limits
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > until:
            room, offset = self.limits.copy(), 0
            while room[1] >= 1 and left:
                fits = alive & (demand <= room).all(axis=1)
                if fits.any():
                    best = int(np.argmax(np.where(fits, weight @ (room / self.limits), -1.0)))
                    document, start, length = items[best]
                    alive[best] = False
                    left -= 1
                else:
                    if room[0] < LEAST_CUT:
                        break
                    best = int(np.argmax(np.where(alive, demand[:, 0], -1.0)))
                    document, start, whole = items[best]
                    length = min(whole, self._longest(document, start, room[0], room[2]))
                    if length < LEAST_CUT:
                        break
                    items[best] = (document, start + length, whole - length)
                    demand[best] = (whole - length, 1, self._loss(document, start + length, start + whole))
                    weight[best] = demand[best] / self.limits
                yield self._piece(document, start, length, offset)
                offset += length
                room -= (length, 1, self._loss(document, start, start + length))
            self.next_id += 1
        self.free = [item for item, stays in zip(items, alive) if stays]


def pack(
    documents: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS,
    end: int = END, loss_from: str | None = None,
) -> DataFrame:
    """Pieces of all documents in sequences: one row per piece, ids as little-endian unsigned 32-bit numbers.

    ``tokenizer`` is a tokenizer file, read on the driver and sent along (a few MB). Each document's ids are followed by ``end``;
    each id lies in exactly one piece. ``loss_from`` names a column with the number of leading ids that bear no loss; by default, and
    where it is missing, all do. No sequence passes a limit. Sequences are meant to be padded to ``tokens``.

    Documents are packed where they lie, without a shuffle: a task leaves at most one sequence that is not as full as
    its limits allow. Names of sequences hold the task's partition, so that a task run again names them alike. Tasks hold
    a bounded number of open pieces, and of texts at a time. A missing or empty text has the end id only; repeated rows are
    packed each; missing ids are kept.
    """
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)
    content = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    first = F.lit(0).cast("long") if loss_from is None else F.coalesce(F.col(loss_from).cast("long"), F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gleaner.llm.tokens import CachedTokenizer

        encoder = CachedTokenizer(content.value)  # ends with the task: workers stay for other stages
        give_back()  # what reading the tokenizer left
        packer = Packer(TaskContext.get().partitionId() << 32, tokens, segments, loss)
        out, held = [], 0

        def told() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            columns[3] = [ids.astype("<u4").tobytes() for ids in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=[
                "doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for begin in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(begin, TEXTS)
                    found = [ids for some in runs(part.column("text"), TEXT_BYTES) for ids in encoder.encode(some)]
                    for doc_id, ids, skip in zip(part.column("doc_id").to_pylist(), found, part.column("skip").to_pylist()):
                        yield from packer.add((doc_id, np.append(ids, np.int32(end)), skip))
                    if len(packer.free) >= POOL:
                        yield from packer.pack(POOL // 2)
            yield from packer.pack(0)

        for piece in pieces():
            out.append(piece)
            held += piece[2]
            if held >= OUT_TOKENS or len(out) >= 20_000:
                yield told()
                out, held = [], 0
        if out:
            yield told()
        del encoder, out
        give_back()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"),
                            first.alias("skip")).mapInArrow(run, PIECES)
