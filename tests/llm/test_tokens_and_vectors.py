"""Whitening, alignment and token counts by brute force, on odd tables and against the tokenizers."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import align, queries, token_counts, whitening
from gleaner.session import stored

SF = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a string, pairs string, size long"
ODD = ["", None, " ", "\n\n \t", "a", "don't we'll I'M", "x" * 3000, " " * 5000 + "end", "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
       "<s>text</s>", "tabs\tand\r\nlines", "ümläut straße café", "漢字かな交じり文", "emoji 👩‍👩‍👧 ok", "mark ▁ inside", "new ჹ ꟎ ט signs",
       "a  b   c    d", "3.14159 2,000,000 ²½", "\x00\x07 control", "word " * 20_000, "́combining", " 　 blanks  ",
       "same text", "same text"]


def odd_texts():
    rng = random.Random(13)
    signs = "ab cdeé ñ'\n\t.,!?-_<>|0123 漢字  ß€😀 ̀"
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 300))) for _ in range(150)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if at == 5 else at // 2 * 2, text, "clash", "clash", 1) for at, text in enumerate(odd_texts())]
    return stored(spark.createDataFrame(rows, SCHEMA), "odd")


@pytest.fixture(scope="module")
def given(spark):
    return [row.text for row in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# Token counts.


def naive_merges(counter, piece):
    symbols = [bytes([byte]) for byte in piece]
    while True:
        ranked = [(counter.ranks[pair], at) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in counter.ranks]
        if not ranked:
            return len(symbols)
        _, at = min(ranked)
        symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]


def test_heap_merges_like_the_naive_rule():
    counter, rng = token_counts.MergeCounter(open(BYTES).read()), random.Random(2)
    for _ in range(400):
        piece = "".join(rng.choice("aaaabcdeehilnorst é") for _ in range(rng.randint(0, 40))).encode()
        assert counter.merged(piece) == naive_merges(counter, piece)
    assert counter.merged(b"aaaa" * 50_000) == len(Tokenizer.from_file(BYTES).encode("aaaa" * 50_000).ids)


def test_token_counts_equal_the_tokenizer(spark, odd, given):
    tokenizer = Tokenizer.from_file(BYTES)

    def want(text):
        return len(tokenizer.encode(text or "", add_special_tokens=False).ids)

    got = odd.select("text", token_counts.token_count(spark, F.col("text"), BYTES).alias("n")).collect()
    assert Counter((row.text, row.n) for row in got) == Counter((text, want(text)) for text in odd_texts())
    told = {row.doc_id: row for row in queries.op13_token_counts(spark, SF).collect()}
    for doc_id, text in enumerate(given):
        row = told[doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), want(text), want(text) > 1024)
    assert odd.limit(0).select(token_counts.token_count(spark, F.col("text"), BYTES).alias("n")).collect() == []


def test_small_memory_of_pieces_changes_nothing(monkeypatch, given):
    monkeypatch.setattr(token_counts, "KNOWN_PIECES", 7)
    counter, tokenizer = token_counts.MergeCounter(open(BYTES).read()), Tokenizer.from_file(BYTES)
    for text in given[:20]:
        assert counter.count(text or "") == len(tokenizer.encode(text or "", add_special_tokens=False).ids)


# Alignment.


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, token by token."""
    a_side, b_side = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    alphabet = token_counts.byte_alphabet()
    groups, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a_ids = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b_ids = b_side.encode(text or "")
        a_bytes = [bytes(alphabet[sign] for sign in a_side.id_to_token(number)) for number in a_ids]
        b_bytes = [bytes([int(piece[3:5], 16)]) if b_side.is_byte(number) else piece.replace("▁", " ").encode()
                   for number, piece in ((number, b_side.id_to_piece(number)) for number in b_ids)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            groups.append(None)
            links.append([])
            continue
        a_ends, b_ends = np.cumsum([len(own) for own in a_bytes]).tolist(), np.cumsum([len(own) for own in b_bytes]).tolist()
        own, at_a, at_b = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            to_a, to_b = a_ends.index(end, at_a) + 1, b_ends.index(end, at_b) + 1
            own.append((a_ids[at_a:to_a], b_ids[at_b:to_b]))
            at_a, at_b = to_a, to_b
        groups.append((len(a_ids), len(b_ids), own))
        links.append([(a[-1], b[-1]) for a, b in own])
    counts = Counter(pair for own in links for pair in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for told, own in zip(groups, links):
        if told is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in told[2])
        out.append((told[0], told[1], len(told[2]), len(own), sum(counts[pair] == most[pair[1]] for pair in own),
                    sum(counts[pair] for pair in own), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_common_stops_are_the_common_ends():
    rng = np.random.default_rng(5)
    for kind in range(300):
        n = int(rng.integers(1, 400))
        keep = rng.random((2, n)) < rng.choice([0.2, 0.6, 0.95, 0.999], 2)[:, None]
        keep[:, -1] = True
        a, b = (np.flatnonzero(own) + 1 for own in keep)
        at_a, at_b = align.common_stops(a, b)
        want, want_a, want_b = np.intersect1d(a, b, return_indices=True)
        assert at_a.tolist() == want_a.tolist() and at_b.tolist() == want_b.tolist()
    none = np.zeros(0, np.int64)
    assert [len(side) for side in align.common_stops(none, none)] == [0, 0]


def test_alignment_matches_brute_force(odd):
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    rows = align.alignment_report(odd, BYTES, PIECES).collect()
    got = Counter((row.doc_id, *[row[name] for name in columns]) for row in rows)
    ids = [None if at == 5 else at // 2 * 2 for at in range(len(odd_texts()))]
    assert got == Counter((doc_id, *told) for doc_id, told in zip(ids, brute_alignment(odd_texts())))
    assert sum(row.n_a == 0 for row in rows) > 2  # the missing, the empty and the changed ones


def test_alignment_query(spark, given):
    got = {row.doc_id: tuple(row)[1:] for row in queries.op12_alignment(spark, SF).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert [got[at] for at in range(len(given))] == brute_alignment(given)


def test_alignment_gives_groups_and_takes_empty_tables(spark, odd):
    aligner = align.Aligner(spark, BYTES, PIECES)
    row = aligner.aligned(spark.createDataFrame([(1, "don't stop")], "doc_id long, text string")).first()
    sides = align.Sides(open(BYTES).read(), open(PIECES, "rb").read())
    a = [sides.a.bytes[number] for number in row.a_ids]
    b = [sides.b.bytes[number] for number in row.b_ids]
    assert b"".join(a) == b"".join(b) == b" don't stop"
    for a_stop, b_stop in zip(row.a_stops, row.b_stops):
        assert b"".join(a[:a_stop]) == b"".join(b[:b_stop])
    assert (row.a_stops[-1], row.b_stops[-1]) == (len(a), len(b))
    assert align.alignment_report(odd.limit(0), BYTES, PIECES).collect() == []


def test_long_texts_take_the_other_library(monkeypatch, given):
    sides = align.Sides(open(BYTES).read(), open(PIECES, "rb").read())
    fast = [sides.a.encode(" " + (text or "")) for text in odd_texts() + given]
    monkeypatch.setattr(align, "PLAIN_CHARS", 0)
    assert sides.a.fast is not None
    assert fast == [sides.a.encode(" " + (text or "")) for text in odd_texts() + given]


# Whitening.


def brute_whitening(vectors, components=16, counted=False):
    """n, exact deviation per distinct vector, eigenvalues and trace, by fractions and one matrix."""
    distinct = Counter(tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in vector) for vector in vectors)
    weight = {x: n if counted else 1 for x, n in distinct.items()}
    n = sum(weight.values())
    sums = [sum(weight[x] * x[at] for x in distinct) for at in range(len(next(iter(distinct))))]
    deviation = {x: sum((n * value - total) ** 2 for value, total in zip(x, sums)) for x in distinct}
    centred = np.array([[float(Fraction(n * value - total, n)) for value, total in zip(x, sums)] for x in distinct])
    factor = np.array([weight[x] for x in distinct], float)
    matrix = (centred * factor[:, None]).T @ centred / n
    values = np.linalg.eigvalsh(matrix)[::-1]
    return n, deviation, values[:components], matrix, dict(zip(distinct, centred))


def scaled(vector):
    return tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in vector)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_matches_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 5)).astype(np.float32)
    vectors = [base[0]] * 60 + [row for row in base] + [base[7]] * 2  # a hot vector and repeats
    rows = [(None if at == 3 else at, [float(c) for c in vector], "clash", 1) for at, vector in enumerate(vectors)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4),
           (904, [1e30, 0.0, 0.0, 0.0, 0.0]), (905, [])]
    table = spark.createDataFrame(rows + [(*row, "clash", 1) for row in bad], "vec_id long, embedding array<float>, x string, n_rows long")
    got = whitening.whiten(table, weights=weights).collect()
    n, deviation, values, matrix, centred = brute_whitening(vectors, counted=weights == "count")
    assert len(got) == 5 * len(vectors)
    white = {}
    for row in got:
        assert row.n == n and row.identity_error < 1e-9
        assert row.explained == pytest.approx(values[row.component - 1] / np.trace(matrix), rel=1e-9)
        white.setdefault((row.vec_id, row.deviation), {}).setdefault(row.component, row.whitened)
    by_id = {row[0]: scaled(row[1]) for row in rows}
    x_all = np.array([centred[by_id[vec_id]] for vec_id, _ in white])
    y_all = np.array([[own[component] for component in range(1, 6)] for own in white.values()])
    assert all(told == deviation[by_id[vec_id]] for vec_id, told in white)
    # Whitened values are projections on unit directions of the covariance, over the root of its values.
    directions = np.linalg.lstsq(x_all, y_all * np.sqrt(values), rcond=None)[0].T
    assert np.allclose(directions @ directions.T, np.eye(5), atol=1e-8)
    assert np.allclose(directions @ matrix, values[:, None] * directions, atol=1e-7)
    assert np.allclose(x_all @ directions.T / np.sqrt(values), y_all, atol=1e-8)


def test_whitening_of_hot_vectors_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(at, rng.integers(0, 4, 3).astype(float).tolist()) for at in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, whitening.whiten(table).collect()))
    monkeypatch.setattr(whitening, "HOT_SHARE", 20)
    assert sorted(map(tuple, whitening.whiten(table).collect())) == plain
    assert len(plain) == 600


def test_whitening_of_odd_tables(spark):
    def whiten(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id", "component").collect()

    assert whiten([]) == [] and whiten([(1, None), (2, [])]) == []
    single = whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])])  # one distinct vector: no variance
    assert [(row.vec_id, row.component, row.n, row.deviation, row.whitened, row.explained, row.identity_error) for row in single] == [
        (vec_id, component, 1, 0, None, None, None) for vec_id in (1, 2) for component in (1, 2)]
    line = whiten([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [3.0])])  # variance in one direction; another length apart
    assert [(row.vec_id, row.component, row.whitened and abs(row.whitened)) for row in line] == [
        (1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None), (3, 1, None)]
    far = whiten([(1, [2.0**55]), (2, [-(2.0**55)])])  # the exact sum of squares has no long number
    assert far[0].deviation is None and int(far[0].exact_deviation) == (2**62) ** 2
    assert abs(far[0].whitened) == pytest.approx(1.0)


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, values, matrix, _ = brute_whitening([row.embedding for row in rows])
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    by_id = {row.vec_id: scaled(row.embedding) for row in rows}
    for row in got:
        assert (row.n, row.deviation) == (n, deviation[by_id[row.vec_id]])
        assert row.explained == pytest.approx(values[row.component - 1] / np.trace(matrix), rel=1e-9)
        assert row.identity_error < 1e-6
