"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums and whole epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import prefix_sums, text_of, uniform, word_count
from gleaner.session import stored

BINS = 1024
# Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3


def text_quality(text: Column) -> Column:
    """A quality weight in [0.05, 1]: lower with more symbols and capitals, and for an empty text."""
    whole = text_of(text)
    plain = F.translate(whole, "#$%&*!|@^~<>=+_/\\{}[]ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    return F.when(F.length(whole) == 0, F.lit(0.05)).otherwise(
        F.greatest(F.lit(0.05), F.length(plain).cast("double") / F.length(whole)))


def source_targets(sizes: DataFrame, most: float = MOST_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, source_size), of which there are few.

    Sources in code point order, a missing one last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``most`` times the size; what lies above is shared again by weight among
    the others. That repeated sharing ends where the sources are filled in order of
    ``most * size / weight``: up to some place all stop, from there on all get weight times one level.
    Sources without words get 0. Adds ``source_no`` and ``target``.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)) + 1)
    numbered = sizes.withColumn("source_no", F.row_number().over(everything) - 1).withColumn("weight", weight)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    levels = numbered.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumns({
        "stopped": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "free": F.sum("weight").over(rest), "all": F.sum("source_size").over(whole)})
    open_level = (F.col("all") - F.col("stopped")) / F.col("free")
    marked = levels.withColumn("open", F.col("cap") > F.col("weight") * open_level)
    at = F.struct(F.col("cap") / F.col("weight"), F.col("source_no"))
    first = F.min(F.when(F.col("open"), F.struct(
        at.alias("at"), F.col("stopped").alias("stopped"), F.col("free").alias("free")))).over(whole)
    return marked.withColumn("first", first).select(
        "source", "source_no", "source_size",
        F.when(F.col("first").isNull() | (at < F.col("first.at")), F.col("cap"))
        .otherwise(F.col("weight") * (F.col("all") - F.col("first.stopped")) / F.col("first.free")).alias("target"))


def keys_of(documents: DataFrame, quality: Column | None = None, seed: str = "mix") -> DataFrame:
    """Add what a document is drawn by: ``size`` in words, ``key`` (exponential, scaled by quality) and ``tie``."""
    weight = text_quality(F.col("text")) if quality is None else quality
    u = uniform(F.lit(seed), F.col("doc_id"), F.md5(text_of(F.col("text"))))
    return documents.withColumns({
        "size": word_count(F.col("text")), "key": -F.log(u) / weight, "tie": F.md5(text_of(F.col("text")))})


def _place() -> Column:
    return F.struct(F.col("key"), F.col("doc_id"), F.col("tie"))


def plan_mix(keyed: DataFrame) -> DataFrame:
    """One row per source: targets, whole epochs and the ``last`` place that the fractional selection takes.

    Each source first gets its whole epochs: target divided by size, rounded down. For the rest, documents are
    taken in the order of their keys while the words before a document, with half of its own, stay within what is left:
    the sum ends as near to the target as whole documents in that order allow.
    """
    totals = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A table of one row per source: Spark sees its size and broadcasts it only if it is small.
    targets = stored(source_targets(totals), "targets")
    matched = keyed.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    # Keys of weight 1 spread evenly over the bins; smaller weights only make keys larger.
    bin_of = F.floor((1 - F.exp(-F.col("key"))) * BINS).cast("int")
    ranked = prefix_sums(matched.select("source_no", "size", "key", "doc_id", "tie", "target", "source_size"),
                         "source_no", bin_of, [F.col("key"), F.col("doc_id"), F.col("tie")], F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - epochs * F.col("source_size")
    taken = ranked.filter((F.col("before") + F.col("size") / 2 <= left) & (epochs < MOST_EPOCHS) & (F.col("size") > 0))
    last = taken.groupBy(F.col("source_no").alias("of_no")).agg(F.max(_place()).alias("last"))
    return stored(targets.withColumn("epochs", epochs.cast("int")).join(
        last, F.col("source_no") == F.col("of_no"), "left").drop("of_no"), "mix-plan")


def with_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies``: whole epochs, and one for rows up to the last place taken."""
    joined = keyed.join(plan.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    extra = F.coalesce((F.col("size") > 0) & (_place() <= F.col("last")), F.lit(False))
    return joined.withColumn("copies", F.col("epochs") + F.when(extra, 1).otherwise(0)).drop(
        "of_source", "source_no", "epochs", "last")


def mix(documents: DataFrame, quality: Column | None = None) -> DataFrame:
    """How many copies of each document the mix takes: doc_id, source, size, key, tie, source_size, target, copies.

    Draws come from id and text, so that reruns agree; equal keys go by id, then text. A missing text has no words and is not drawn;
    a missing source is a source of its own; rows that repeat id and text are drawn together. Sources without words have the target 0.
    An empty table gives no rows. ``quality`` is a column of weights above 0; by default the text's own.
    """
    keyed = stored(keys_of(documents.select("doc_id", "text", "source"), quality).drop("text"), "keys")
    return with_copies(keyed, plan_mix(keyed))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``documents``.

    The plan is made on keys alone and joined to the documents where they lie: texts are not shuffled.
    """
    plan = plan_mix(stored(keys_of(documents.select("doc_id", "text", "source")).drop("text"), "keys"))
    whole = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", "text", "source")
    taken = with_copies(keys_of(whole), plan)
    return taken.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select(
        *[F.col("row")[name].alias(name) for name in documents.columns])
