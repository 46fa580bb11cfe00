"""Documents to overlapping chunks."""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import is_blank
from gleaner.schema import CHUNK_OVERLAP, CHUNK_TOKENS

# A token is a run outside this class together with the blanks behind it, so that the
# tokens of a text joined again give the text, line breaks included. The class is spelled
# out because \s differs between regex engines.
TOKEN_PATTERN = "[^ \\t\\n\\r]+[ \\t\\n\\r]*"
# The same without a way back, so that Java's regex counts repeated tokens in a loop, not on its stack.
_WHOLE_TOKEN = "[^ \\t\\n\\r]++[ \\t\\n\\r]*+"


def window_chunks(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (chunk_no, text): windows of ``size`` tokens, ``overlap`` shared.

    The text is split into runs of as many tokens as divide both ``size`` and ``overlap``: windows begin and end
    between runs, and no row is made of every token. The array of runs is bound by the outer ``transform``: a lambda
    body that held the pattern itself would split the text again for every window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than size")
    unit = math.gcd(size, overlap)
    stride = (size - overlap) // unit

    def windows(runs: Column) -> Column:
        count = F.greatest(
            F.ceil((F.size(runs) - overlap // unit) / F.lit(float(stride))).cast("int"), F.lit(1)
        )
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                i.alias("chunk_no"),
                F.array_join(F.slice(runs, i * stride + 1, F.lit(size // unit)), "").alias("text"),
            ),
        )

    runs = F.regexp_extract_all(text, F.lit(f"(?:{_WHOLE_TOKEN}){{1,{unit}}}+"), F.lit(0))
    return F.transform(F.array(runs), windows)[0]


_CHUNK_ARRAY = T.ArrayType(T.StructType([
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
]))

# A sentence ends behind stop marks that blanks follow, or at a line break.
_SENTENCE_END = re.compile(r"[.!?]+[ \t\n\r]+|\n[ \t\n\r]*")
_TOKEN = re.compile(TOKEN_PATTERN)


def pack_sentences(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Greedy packing of whole sentences into at most ``size`` tokens.

    The next chunk starts again with the last sentences that fit into ``overlap`` tokens,
    unless they leave no room for the sentence after them. A sentence of more than ``size``
    tokens is cut into pieces of ``size``.
    """
    pieces: list[str] = []
    widths: list[int] = []
    borders = [0, *(end.end() for end in _SENTENCE_END.finditer(text)), len(text)]
    for begin, end in pairwise(borders):
        tokens = _TOKEN.findall(text, begin, end)
        for at in range(0, len(tokens), size):
            pieces.append("".join(tokens[at:at + size]))
            widths.append(len(tokens[at:at + size]))
    ends = np.concatenate(([0], np.cumsum(widths)))
    chunks: list[tuple[int, str]] = []
    start, last = 0, len(pieces)
    while start < last:
        stop = int(np.searchsorted(ends, ends[start] + size, side="right")) - 1
        chunks.append((len(chunks), "".join(pieces[start:stop])))
        if stop == last:
            break
        start = max(
            int(np.searchsorted(ends, ends[stop] - overlap, side="left")),
            int(np.searchsorted(ends, ends[stop + 1] - size, side="left")),
            start + 1,
        )
    return chunks


def sentence_chunks(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of (chunk_no, text) by whole sentences; an Arrow UDF over batches of texts."""

    @F.arrow_udf(_CHUNK_ARRAY)
    def pack(texts: pa.Array) -> pa.Array:
        packed = [pack_sentences(text, size, overlap) for text in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, packed)], dtype=np.int32)
        numbers = pa.array([no for chunks in packed for no, _ in chunks], pa.int32())
        pieces = pa.array([piece for chunks in packed for _, piece in chunks], pa.string())
        rows = pa.StructArray.from_arrays([numbers, pieces], names=["chunk_no", "text"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    return pack(text)


def chunk_documents(
    documents: DataFrame,
    mode: str = "window",
    size: int = CHUNK_TOKENS,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per chunk with the metadata of its document; blank documents give none.

    Chunks are built inside one array and exploded as small structs: exploding window
    numbers next to the text would copy a long text once per window. No shuffle.
    """
    split = {"window": window_chunks, "sentence": sentence_chunks}[mode]
    metadata = [c for c in documents.columns if c != "text"]
    chunked = documents.where(~is_blank(F.col("text"))).select(
        *metadata, F.explode(split(F.col("text"), size, overlap)).alias("chunk")
    )
    return chunked.select(*metadata, "chunk.chunk_no", "chunk.text")


def chunk_id(collection: Column, source: Column, place: Column, chunk_no: Column) -> Column:
    """Deterministic key of a chunk."""
    return F.sha2(F.concat_ws("|", collection, source, place, chunk_no.cast("string")), 256)
