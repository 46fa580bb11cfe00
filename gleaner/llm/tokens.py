"""Token ids of whole texts by a tokenizer file, with a table of word pieces."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

# How the tokenizer cuts lower-case words into pieces, for characters up to U+00FF. The patterns are
# runs of letters, single numbers, runs of other marks, and these endings behind an apostrophe that begins a run.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANKS = "\x09-\x0d\x20\x85\xa0"
_ENDINGS = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
TABLE_PIECES = 400_000


def _classes() -> np.ndarray:
    kinds = np.full(256, 3, np.uint8)
    for code in range(256):
        for kind, signs in enumerate((_BLANKS, _LETTERS, _NUMBERS)):
            if re.fullmatch(f"[{signs}]", chr(code)):
                kinds[code] = kind
    return kinds


_KINDS = _classes()
_POWERS = np.random.default_rng(10).integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class CachedTokenizer:
    """Ids of texts, equal to those of the tokenizer.

    This kind of tokenizer (lower case, white space dropped, word ends marked) cuts a text into pieces and encodes each piece by
    itself. Texts of characters up to U+00FF are cut here, many at a time; pieces are told apart by 64-bit hashes and looked up in
    a sorted table. New pieces are encoded by the tokenizer in long lines, where each ends with one end-of-word id.
    Other texts, texts that hold the string of an added token, and tokenizers of another kind are encoded whole.
    """

    def __init__(self, content: str) -> None:
        self.tokenizer = Tokenizer.from_str(content)
        self.by_piece = '"end_of_word_suffix":"</w>"' in content.replace(" ", "") and '"Lowercase"' in content
        vocabulary = self.tokenizer.get_vocab() if self.by_piece else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[number for piece, number in vocabulary.items() if piece.endswith("</w>")]] = True
        self.added = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.int32) for found in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Put the ids of new pieces, in ascending order of their keys, into the table."""
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for at in range(0, len(pieces), 2000):
            some = pieces[at:at + 2000]
            ids = self._plain([" ".join(some)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                single = self._plain(some)
                ids, stops = np.concatenate(single), np.cumsum([len(own) for own in single])
            found.append(ids)
            sizes.append(np.diff(stops, prepend=0))
        new = np.concatenate(sizes)
        total = int(new.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = np.concatenate(found)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(new) - new)
        self.sizes = np.insert(self.sizes, at, new)
        self.used += total

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-case Latin texts without endings behind apostrophes."""
        line = "\n".join(texts) + "\n"
        codes = np.frombuffer(line.encode("latin-1"), np.uint8)
        kinds = _KINDS[codes]
        edge = np.empty(len(kinds), bool)
        edge[0] = kinds[0] != 0
        edge[1:] = (kinds[1:] != 0) & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == 2))
        starts = np.flatnonzero(edge)
        begins = np.cumsum([0] + [len(text) + 1 for text in texts])
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        inside = np.flatnonzero(kinds)
        heads = np.searchsorted(inside, starts)
        lengths = np.diff(np.append(heads, len(inside)))
        place = np.arange(len(inside)) - np.repeat(heads, lengths)
        flat = (codes[inside].astype(np.uint64) + np.uint64(1)) * (
            _POWERS[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
        hashes = np.add.reduceat(flat, heads)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > TABLE_PIECES:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            froms = starts[first[new]]
            tos = froms + lengths[first[new]]
            self._learn(keys[new], [line[a:b] for a, b in zip(froms.tolist(), tos.tolist())])
            at = np.searchsorted(self.keys, keys)
        at = at[which]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        if not self.by_piece:
            return self._plain(texts)
        out: list = [None] * len(texts)
        latin, rest = [], []
        for at, text in enumerate(texts):
            low = text.lower()
            plain = _is_latin(low) and not any(content in low for content in self.added)
            (latin if plain and not ("'" in low and _ENDINGS.search(low)) else rest).append((at, low if plain else text))
        for at, ids in zip([at for at, _ in rest], self._plain([texts[at] for at, _ in rest]) if rest else []):
            out[at] = ids
        for at, ids in zip([at for at, _ in latin], self._cut([low for _, low in latin]) if latin else []):
            out[at] = ids
        return out
