"""Reachability over a page snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import folder_bytes, scratch_path, stored


# A round of at most so many new URLs names them to the scan of a link table of more than so many bytes.
FEW_URLS = 1_000
LARGE_TABLE = 1 << 30


def part_of(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """The rows of a table bucketed by URL that ``urls`` may name: few URLs go into the filter, and choose its buckets."""
    few = urls.where("url is not null").limit(FEW_URLS + 1).collect()
    return nodes if len(few) > FEW_URLS else nodes.where(F.col("url").isin([row["url"] for row in few]))


def reachable(pages: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first visit of ``pages`` (url, kept, targets) from ``seeds`` (url).

    Result: url, depth, found (the snapshot has the page), kept. Links are followed from
    kept pages only; each URL is visited once, at its least depth. Every round writes its
    new URLs to the shared folder, so a round reads files and not the plan of all rounds.

    The link table is bucketed and sorted by URL once. Where it is large, a round with few new URLs reads their buckets only, and
    in them the row groups that can hold them; any other round shuffles its frontier, and the table stays in place.
    """
    spark = pages.sparkSession
    table = f"links_{uuid.uuid4().hex}"
    place = scratch_path(spark, "links")
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        pages.repartition(n_buckets, "url")
        .groupBy("url").agg(F.max(F.struct("kept", "targets")).alias("page"))
        .select("url", "page.kept", "page.targets")
        .write.bucketBy(n_buckets, "url").sortBy("url")
        .option("path", place).saveAsTable(table)
    )
    nodes = spark.table(table)
    large = folder_bytes(spark, place) > LARGE_TABLE
    visited_path = scratch_path(spark, "visited")

    def add(urls: DataFrame, depth: int) -> DataFrame:
        """Write a round's URLs with what the link table tells of them: its one scan in the round."""
        urls, wanted = urls.select("url").dropDuplicates(), nodes
        if large:
            urls = stored(urls, "urls")
            wanted = part_of(nodes, urls)
        (
            urls.join(wanted, "url", "left")
            .select(
                "url",
                F.col("kept").isNotNull().alias("found"),
                F.coalesce("kept", F.lit(False)).alias("kept"),
                F.when(F.col("kept"), F.col("targets")).alias("targets"),
            )
            .write.parquet(f"{visited_path}/depth={depth}")
        )
        return spark.read.parquet(f"{visited_path}/depth={depth}")

    def visited() -> DataFrame:
        return spark.read.parquet(visited_path)

    try:
        depth = 0
        frontier = add(seeds, depth)
        while (max_depth is None or depth < max_depth) and not frontier.where("kept").isEmpty():
            linked = frontier.select(F.explode("targets").alias("url")).dropDuplicates()
            new = linked.join(visited().select("url"), "url", "left_anti")
            depth += 1
            frontier = add(new, depth)
    finally:
        spark.sql(f"DROP TABLE {table}")
    return visited().select("url", F.col("depth").cast("int").alias("depth"), "found", "kept")
