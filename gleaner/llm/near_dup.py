"""MinHash near-dedup: tensored banding, sketches and a check of full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import components, give_back, slices, small_batches, text_of
from gleaner.session import ship_package, stored

SHINGLE = 5  # words
SIMILAR = 75  # percent
COLLECTIONS = 14  # per side: 28 keys stand for 14 * 14 tables
ROWS = 2  # hashes per key: a table key has 4
HASHES = 2 * COLLECTIONS * ROWS
LIKELY = 0.5  # share of equal hashes below which a pair is not similar: 4.3 deviations below 0.75
CHUNK = 400_000  # characters hashed together
BLOCK = 2048  # members of a key compared in one task
TASK_TEXT = 2 << 20  # bytes of rows that a task turns into Python objects at a time
LONG = 4096  # sets above this size are compared by sketch, then in full
SMALL_NODES = 1_000_000  # ids of 8 bytes

_RNG = np.random.default_rng(20)
_PLACES = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_BANDS = _RNG.integers(1, 2**63, (2 * COLLECTIONS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_chunk(texts: list[str]) -> list[np.ndarray]:
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum([0] + [len(text) + 1 for text in texts[:-1]])
    inside = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    letters = codes + 32 * ((codes >= 65) & (codes <= 90)).astype(np.uint32)
    owner = np.repeat(starts, stops - starts)
    flat = letters[inside].astype(np.uint64)
    place = np.flatnonzero(inside) - owner
    flat = flat * (_PLACES[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
    words = _mix(np.add.reduceat(flat, np.cumsum(stops - starts) - (stops - starts)))
    doc = np.searchsorted(begins, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    last = np.searchsorted(doc, np.arange(len(texts)), "right")
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for step in range(SHINGLE):
        rolled += words[step:len(rolled) + step] * _STEPS[step]
    rolled = _mix(rolled)
    out = []
    for low, high in zip(first, last):
        if high - low >= SHINGLE:
            out.append(np.unique(rolled[low:high - SHINGLE + 1]))
        elif high > low:
            own = (words[low:high] * _STEPS[:high - low]).sum(dtype=np.uint64)
            out.append(_mix(np.array([own ^ np.uint64(high - low)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each whole text."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        out += _hash_chunk(texts[at:end])
        at = end
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set; all sets hold something."""
    lengths = np.array([len(own) for own in sets])
    heads = np.cumsum(lengths) - lengths
    keys = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for at in range(HASHES):
        out[:, at] = np.minimum.reduceat(keys * _FACTORS[at] + _SHIFTS[at], heads)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """The keys of both sides' collections, ROWS hashes each; a key also tells its collection."""
    grouped = minima.reshape(len(minima), 2 * COLLECTIONS, ROWS).astype(np.uint64)
    mixed = _mix((grouped * _BANDS[None, :, :]).sum(axis=2, dtype=np.uint64) + np.arange(2 * COLLECTIONS, dtype=np.uint64))
    tag = np.arange(2 * COLLECTIONS, dtype=np.uint64) << np.uint64(58)
    return ((mixed >> np.uint64(6)) | tag[None, :]).astype(np.int64)


def _node(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


_SKETCH = "doc_id long, mark string, n_shingles long, node long, bands array<long>, sketch binary"


def sketches(documents: DataFrame, mark: Column | None = None) -> DataFrame:
    """One row per document: ``mark``, its set's size, name, band keys and 16 bits of each hash; empty sets have none."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1000, TASK_TEXT):
                sets = shingle_sets(part.column("text").to_pylist())
                full = [at for at, own in enumerate(sets) if len(own)]
                bands: list = [None] * len(sets)
                short: list = [None] * len(sets)
                for low in range(0, len(full), 128):
                    some = full[low:low + 128]
                    minima = min_hashes([sets[at] for at in some])
                    keys = band_keys(minima)
                    for place, at in enumerate(some):
                        bands[at] = keys[place]
                        short[at] = minima[place].astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("mark"), pa.array([len(own) for own in sets], pa.int64()),
                    pa.array([_node(own) if len(own) else None for own in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary()),
                ], names=["doc_id", "mark", "n_shingles", "node", "bands", "sketch"])
        give_back()

    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.lit(None) if mark is None else mark).cast("string").alias("mark"),
        text_of(F.col("text")).alias("text")).mapInArrow(sketch, _SKETCH)


def _alike(left: str, right: str) -> Column:
    """Share of equal hashes of two sketches."""

    @F.arrow_udf("double")
    def share(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            a, b = (np.frombuffer(b"".join(side.to_pylist()), "<u2").reshape(-1, HASHES) for side in (one, two))
            yield pa.array((a == b).mean(axis=1) if len(a) else np.zeros(0), pa.float64())

    # Told to be not deterministic: a filter on the share else compares the sketches again in a worker of its own.
    return share.asNondeterministic()(left, right)


def _sets_of(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Full sets (node, shingles) of ``nodes`` (node, doc_id), read from the whole texts again."""
    nodes = stored(nodes, "nodes")
    few = nodes.count() <= SMALL_NODES
    ids = nodes.select(F.col("doc_id").alias("wanted")).distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for own in shingle_sets(batch.column("text").to_pylist()) if len(own)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_node(own) for own in sets], pa.int64()),
                pa.array([own.astype("<u8").tobytes() for own in sets], pa.binary())], names=["node", "shingles"])

    sets = rows.select("text").mapInArrow(build, "node long, shingles binary")
    return stored(sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(documents: DataFrame, pairs: DataFrame, nodes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar; ``sets``, if given, holds all their nodes."""
    if sets is None:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        sets = _sets_of(documents, nodes.join(ends, "node", "left_semi"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")

    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lefts, rights in batches:
            out = []
            for left, right in zip(lefts, rights):
                a, b = np.frombuffer(left.as_buffer(), "<u8"), np.frombuffer(right.as_buffer(), "<u8")
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                out.append(100 * common >= SIMILAR * (len(a) + len(b) - common))
            yield pa.array(out, pa.bool_())

    return both.filter(similar("left", "right")).select("a", "b")


def _link(
    documents: DataFrame, pairs: DataFrame, nodes: DataFrame, links: DataFrame | None, sets: DataFrame | None = None,
) -> DataFrame:
    """Links known so far and those of ``pairs`` (a, b, alike) that join what is apart.

    Each node's most similar pair is checked first. A pair whose ends are connected by then
    needs no check; all others are checked.
    """
    best = stored(pairs.groupBy("b").agg(F.max(F.struct("alike", "a")).alias("top")).select("top.a", "b"), "best")
    found = _verified(documents, best, nodes, sets)
    links = stored(found if links is None else links.union(found), "verified")
    reach = components(links)
    rest = _apart(pairs, reach).join(best, ["a", "b"], "left_anti")
    rest = stored(rest.select("a", "b"), "rest")
    if rest.isEmpty():
        return links
    return stored(links.union(_verified(documents, rest, nodes, sets)), "verified")


def _apart(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs (a, b) with ends in different components."""
    ends = pairs
    for side in ("a", "b"):
        ends = ends.join(reach.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return ends.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def _with_sketches(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    return pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("left")), "a").join(
        sketch.select(F.col("node").alias("b"), F.col("sketch").alias("right")), "b")


def _pairs_across(left_no: int, ids: np.ndarray, comp: np.ndarray, sketch: np.ndarray, short: list[np.ndarray]):
    """Pairs (a, b, alike) of the members of one left key that meet in a table and may be similar.

    A table key is the left key with one of the right keys; a pair is told under its first common left key only. Sketches
    rule out most; then 16 bits of every shingle, which can only make a pair look more alike.
    Of the pairs of a node and a component one is enough where it is certain; else all doubtful ones are told.
    """
    _, at, size = np.unique(comp, return_inverse=True, return_counts=True)
    weight = size[at].astype(np.int64) * (len(size) + 1) + at  # smaller components first, equal within one
    seen = np.zeros(1 << 16, bool)
    for begin in range(0, len(ids), 32):
        part = slice(begin, begin + 32)
        likely = weight[part, None] < weight[None, :]
        if not likely.any():
            continue
        same = sketch[part, None, :] == sketch[None, :, :]
        share = same.mean(axis=2)
        whole = same.reshape(*same.shape[:2], 2 * COLLECTIONS, ROWS).all(axis=3)
        likely &= (share >= LIKELY) & (whole[:, :, :COLLECTIONS].argmax(axis=2) == left_no) & whole[:, :, COLLECTIONS:].any(axis=2)
        for row in np.flatnonzero(likely.any(axis=1)):
            one, others = row + begin, np.flatnonzero(likely[row])
            lengths = np.array([len(short[other]) for other in others])
            seen[short[one]] = True
            common = np.add.reduceat(seen[np.concatenate([short[other] for other in others])].astype(np.int64),
                                     np.cumsum(lengths) - lengths)
            seen[short[one]] = False
            alike = common / (lengths + len(short[one]) - common)
            long = np.maximum(lengths, len(short[one])) > LONG
            alike = np.where(long, share[row, others], alike)
            sure = ~long & (alike >= SIMILAR / 100 + 0.05)
            doubtful = (long | (alike >= SIMILAR / 100 - 0.02)) & ~np.isin(at[others], at[others[sure]])
            first = np.flatnonzero(sure)[np.unique(at[others[sure]], return_index=True)[1]]
            for place in [*first, *np.flatnonzero(doubtful)]:
                yield int(min(ids[one], ids[others[place]])), int(max(ids[one], ids[others[place]])), float(alike[place])


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, alike) that may link different components of ``rows``: key, members, node, component, sketch, shingles.

    A key of more than ``BLOCK`` members is cut into blocks, and each two blocks are compared in a task of their own. Pairs are
    formed and ruled out within a task; few leave it.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "node", "component", "sketch", "short")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def pairs_of() -> pa.RecordBatch:
            ids, comp = (np.array([row[at] for row in rows]) for at in (0, 1))
            sketch = np.frombuffer(b"".join(row[2] for row in rows), "<u2").reshape(-1, HASHES)
            short = [np.frombuffer(row[3], "<u2") for row in rows]
            found = list(_pairs_across(held[0] >> 58, ids, comp, sketch, short))
            columns = list(zip(*found)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["a", "b", "alike"])

        for batch in batches:
            for part in slices(batch, 1000, TASK_TEXT):
                columns = [part.column(name).to_pylist() for name in (
                    "key", "low", "high", "node", "component", "sketch", "short")]
                for key, low, high, *row in zip(*columns):
                    if held != (key, low, high):
                        if len(rows) > 1:
                            yield pairs_of()
                        held, rows = (key, low, high), []
                    rows.append(row)
        if len(rows) > 1:
            yield pairs_of()
        rows = []
        give_back()

    group = ["key", "low", "high"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        compare, "a long, b long, alike double").dropDuplicates(["a", "b"])


def _shortened(shingles: Column) -> Column:
    """16 bits of every shingle of a set, distinct."""

    @F.arrow_udf("binary")
    def shorten(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([np.unique(np.frombuffer(own, "<u8").astype("<u2")).tobytes() for own in batch.to_pylist()], pa.binary())

    return shorten(shingles)


def linked_rows(documents: DataFrame, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, n_shingles, node, root), one per document, and (node, doc_id, root), one per distinct set.

    ``root`` names the component of a row, whatever its id; a row without shingles has no node and no root. ``mark`` is
    carried along. Two documents are linked if their sets of distinct word shingles have a Jaccard similarity of 0.75 or more; a component is
    what links reach. A text of fewer words than a shingle is one shingle; one
    without words, and a missing text, has none and is linked with nothing. Copies of a set are one node from the start.

    Tensored banding: two sides of COLLECTIONS keys stand for COLLECTIONS**2 tables, whose keys are pairs of a
    left and a right key. A pair of similarity 0.75 meets in none of them once in 50,000 cases. The pairs of keys
    are formed only where they can still matter:

    1. each single key's members are compared with its smallest member (a star, not all pairs);
    2. keys whose members are connected by then are done; rows that keep both a left and a right key go on;
    3. the members of each left key form table keys with their right keys; those of different components that
       meet in a table are compared, by sketch, then by short forms of all shingles.

    Each pair that may be similar, of what is not yet connected, is checked on full sets.
    """
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)
    every = stored(sketches(documents, mark), "sketches")
    nodes = stored(every.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    first = every.filter("node IS NOT NULL").select("node", "doc_id", "bands", "sketch").join(
        nodes.withColumnRenamed("doc_id", "least"), "node").filter(
        F.col("doc_id").eqNullSafe(F.col("least"))).drop("least", "doc_id").dropDuplicates(["node"])
    first = stored(first, "first")
    sketch = first.select("node", "sketch")
    keys = first.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("star")).filter("members > 1")
    keys = stored(keys.join(shared, "key"), "keys")
    stars = keys.filter("star <> node").select(F.col("star").alias("a"), F.col("node").alias("b")).distinct()
    stars = stored(_with_sketches(stars, sketch).withColumn("alike", _alike("left", "right")).filter(
        F.col("alike") >= LIKELY).select("a", "b", "alike"), "stars")
    links = _link(documents, stars, nodes, None)
    reach = components(links)
    placed = keys.join(reach, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(
        "low <> high").select("key")
    is_left = F.shiftrightunsigned("key", 58) < COLLECTIONS
    inside = stored(placed.join(open_keys, "key"), "open")
    both_sides = inside.groupBy("node").agg(F.max(is_left).alias("l"), F.max(~is_left).alias("r")).filter("l AND r").select("node")
    lefts = inside.filter(is_left).join(both_sides, "node", "left_semi")
    mixed = lefts.groupBy("key").agg(
        F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).filter(
        "low <> high").select("key", "members")
    lefts = stored(lefts.join(mixed, "key"), "lefts")
    if not lefts.isEmpty():
        wanted = lefts.select("node").distinct()
        sets = _sets_of(documents, nodes.join(wanted, "node", "left_semi"))
        fine = stored(sets.select("node", _shortened(F.col("shingles")).alias("short")).join(sketch, "node"), "fine")
        across = stored(_across(lefts.join(fine, "node")), "across")
        if not across.isEmpty():
            links = _link(documents, across, nodes, links, sets)
            reach = components(links)
    root = F.coalesce("component", "node").alias("root")
    return (every.join(reach, "node", "left").select("doc_id", "mark", "n_shingles", "node", root),
            nodes.join(reach, "node", "left").select("node", "doc_id", root))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A component of :func:`linked_rows` is named by its smallest id. Rows that repeat an id are rows of their own; a row is kept
    if its id is its component's, so that all rows of that id are.
    """
    rooted, nodes = linked_rows(documents)
    names = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    told = rooted.join(names, "root", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))


def row_fates(documents: DataFrame, mark: Column) -> DataFrame:
    """One row per document with shingles: doc_id, mark, kept.

    One row of each component stays: that of the smallest id, a missing one last, then of the smallest ``mark``. Rows that
    repeat both are all marked as kept.
    """
    rooted, _ = linked_rows(documents, mark)
    place = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("mark"))
    rooted = rooted.filter("node IS NOT NULL").select("doc_id", "mark", "root", place.alias("place"))
    first = rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("place").alias("first"))
    return rooted.join(first, F.col("root") == F.col("of_root")).select(
        "doc_id", "mark", F.col("place").eqNullSafe(F.col("first")).alias("kept"))
