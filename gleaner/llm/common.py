"""Shared pieces: table access, deterministic draws, distributed prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import ship_package, small_batches, stored

# White space and words of all operators here (regular expression, code points).
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; workers get this package with it."""
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    """The text, a missing one as an empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for an empty or missing text."""
    return F.filter(F.split(F.translate(text_of(text), SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` alone: 52 bits of their MD5."""
    joined = F.concat_ws(":", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def drawn(key: Column, share: float) -> Column:
    """True for about ``share`` of all keys, by hash, however small the share; false for a missing key."""
    bits = F.xxhash64(key)
    place = F.pmod(bits, F.lit(10**6)) * 10**6 + F.pmod(F.shiftrightunsigned(bits, 32), F.lit(10**6))
    return key.isNotNull() & (place < int(10**12 * min(1.0, share)))


def slices(batch: pa.RecordBatch, rows: int, n_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``n_bytes`` bytes, one row at least."""
    step = max(1, min(rows, int(n_bytes * batch.num_rows / max(1, batch.nbytes))))
    for begin in range(0, batch.num_rows, step):
        yield batch.slice(begin, step)


def give_back() -> None:
    """Return memory that a task has done with to the system: Python workers stay for the stages to come."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a system without it
        pass


def prefix_sums(
    df: DataFrame, group: str, bin_of: Column, order: list[Column], amount: Column, out: str = "before",
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows that precede a row in its group (a number, never missing).

    Rows of a group are ordered by bin, then by ``order``; ``bin_of`` must not contradict the
    order. A group may hold any share of the rows: only the rows of one bin meet in a task,
    and the offsets of bins come from sums that are combined before the shuffle.
    """
    marked = df.withColumns({"__ps_bin": bin_of, "__ps_amount": amount})
    sums = marked.groupBy(group, "__ps_bin").agg(F.sum("__ps_amount").alias("__ps_sum"))
    offsets = sums.select(
        F.col(group).alias("__ps_group"), F.col("__ps_bin").alias("__ps_at"),
        (F.sum("__ps_sum").over(Window.partitionBy(group).orderBy("__ps_bin")) - F.col("__ps_sum")).alias("__ps_offset"))
    inner = Window.partitionBy(group, "__ps_bin").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = marked.withColumn("__ps_inner", F.sum("__ps_amount").over(inner) - F.col("__ps_amount"))
    joined = ranked.join(
        offsets, (F.col(group) == F.col("__ps_group")) & (F.col("__ps_bin") == F.col("__ps_at")))
    return joined.withColumn(out, F.col("__ps_offset") + F.col("__ps_inner")).drop(
        "__ps_bin", "__ps_amount", "__ps_group", "__ps_at", "__ps_offset", "__ps_inner")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): rows (node, component).

    The component is the smallest node reachable. Every round hangs each node on its
    smallest neighbour, follows two such steps and contracts the links, so that the rounds
    grow with the logarithm of a path and the links shrink. Tables between the rounds are
    written to the shared folder.
    """
    both = stored(
        links.filter("a <> b").select("a", "b")
        .union(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    where = None
    while not both.isEmpty():
        hung = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("root"))
        for _ in range(2):
            up = hung.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            hung = stored(hung.join(up, "root", "left").select(
                "node", F.coalesce("higher", "root").alias("root")), "hung")
        where = hung if where is None else stored(
            where.join(hung.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left")
            .select("node", F.coalesce("higher", "root").alias("root")), "where")
        roots_a = hung.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        roots_b = hung.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        both = stored(
            both.join(roots_a, "a").join(roots_b, "b").filter("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if where is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return where.select("node", F.col("root").alias("component"))
