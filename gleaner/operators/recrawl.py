"""Depths of a crawl kept up to date when pages appear, change or go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.crawl import FEW_URLS
from gleaner.session import stored


@dataclass(frozen=True)
class Crawled:
    """A finished crawl: the pages (url, kept, targets; a row per URL), the links (src, dst) of its kept pages, sorted by
    ``dst`` where they are many, the seeds (url), and what ``reachable`` found (url, depth, found, kept)."""

    pages: DataFrame
    links: DataFrame
    seeds: DataFrame
    visited: DataFrame


def links_of(pages: DataFrame) -> DataFrame:
    """Links (src, dst) of kept pages."""
    return pages.where("kept").select(F.col("url").alias("src"), F.explode("targets").alias("dst")).distinct()


def _of(table: DataFrame, key: str, urls: DataFrame) -> DataFrame:
    """Rows of a table whose ``key`` is among ``urls`` (url): few of them go into the filter of its scan."""
    few = urls.limit(FEW_URLS + 1).collect()
    if len(few) <= FEW_URLS:
        return table.where(F.col(key).isin([row["url"] for row in few]))
    return table.join(urls.select(F.col("url").alias(key)), key, "left_semi")


def _but(rows: DataFrame, others: DataFrame) -> DataFrame:
    return rows.join(others.select("url"), "url", "left_anti")


def recrawl(crawled: Crawled, changes: DataFrame) -> DataFrame:
    """What a crawl of the changed pages would find (url, depth, found, kept), from what the last one found.

    ``changes`` (url, kept, targets) has the new row of each page that appeared or changed; ``kept`` is missing for one
    that went. Two sweeps by depth look at what is affected and read other pages by their URL only. The first, from links that are gone,
    finds the URLs that no page one step nearer leads to any more. The second, from their remaining parents and from new links, gives
    depths to these, and lower depths to others. Rounds grow with the depths that change, and each writes its URLs.
    """
    changes = stored(changes.groupBy("url").agg(F.max(F.struct("kept", "targets")).alias("page")).select("url", "page.*"), "changes")
    present = changes.where("kept is not null")
    visited, seeds = crawled.visited, crawled.seeds.select("url").distinct()
    old_links = stored(links_of(_of(crawled.pages, "url", changes)), "old_links")
    new_links = stored(links_of(present), "new_links")

    def parents_of(urls: DataFrame) -> DataFrame:
        """Links (src, dst) to ``urls`` after the changes."""
        kept = _of(crawled.links, "dst", urls).join(changes.select(F.col("url").alias("src")), "src", "left_anti")
        return kept.select("src", "dst").unionByName(_of(new_links, "dst", urls).select("src", "dst"))

    def targets_of(urls: DataFrame) -> DataFrame:
        """Links (src, dst) from ``urls`` after the changes."""
        return links_of(_but(_of(crawled.pages, "url", urls), changes)).unionByName(_of(new_links, "src", urls).select("src", "dst"))

    def depths(urls: DataFrame, name: str) -> DataFrame:
        """Depths of the last crawl (``name``, depth) of some URLs."""
        return _of(visited, "url", stored(urls.select(F.col(name).alias("url")).distinct(), "urls")).select(F.col("url").alias(name), "depth")

    def steps(links: DataFrame) -> DataFrame:
        """URLs (url, depth) one step behind a visited page that a link leads to, by the depths of the last crawl."""
        near = links.join(depths(links, "src").withColumnRenamed("depth", "from_depth"), "src")
        return near.join(depths(links, "dst"), "dst").where("depth = from_depth + 1").select(F.col("dst").alias("url"), "depth").distinct()

    # URLs that lose their depth.
    lost = stored(visited.select("url", "depth").limit(0), "lost")
    doubtful = stored(_but(steps(stored(old_links.join(new_links, ["src", "dst"], "left_anti"), "gone")), seeds), "doubtful")
    while (level := doubtful.agg(F.min("depth")).first()[0]) is not None:
        now = stored(doubtful.where(F.col("depth") == level).select("url").distinct(), "now")
        links = stored(parents_of(now), "parents")
        above = depths(links, "src").where(F.col("depth") == level - 1).withColumnRenamed("src", "url")
        held = links.join(_but(above, lost).select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        fallen = stored(_but(now, held).withColumn("depth", F.lit(level)), "fallen")
        lost = stored(lost.unionByName(fallen), "lost")
        behind = steps(stored(targets_of(fallen), "targets"))
        doubtful = stored(_but(doubtful.where(F.col("depth") > level).unionByName(_but(behind, seeds)).distinct(), lost), "doubtful")

    # Depths of what was lost, and lower ones.
    standing = _but(visited, lost).select("url", "depth")

    def reached_by(links: DataFrame) -> DataFrame:
        """URLs (url, depth) that links from standing pages lead to."""
        return links.join(_but(depths(links, "src").withColumnRenamed("src", "url"), lost).select(F.col("url").alias("src"), "depth"), "src").select(
            F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))

    settled = stored(standing.limit(0), "settled")
    added = stored(new_links.join(old_links, ["src", "dst"], "left_anti"), "added")
    open_ends = stored(reached_by(stored(parents_of(lost), "parents")).unionByName(reached_by(added)), "open")
    while (level := open_ends.agg(F.min("depth")).first()[0]) is not None:
        now = stored(_but(open_ends.where(F.col("depth") == level).select("url").distinct(), settled), "now")
        nearer = _but(_of(visited, "url", now), lost).where(F.col("depth") <= level)
        now = stored(_but(now, nearer).withColumn("depth", F.lit(level)), "now")
        settled = stored(settled.unionByName(now), "settled")
        behind = targets_of(now).select(F.col("dst").alias("url"), F.lit(level + 1).alias("depth"))
        open_ends = stored(open_ends.where(F.col("depth") > level).unionByName(behind).distinct(), "open")

    told = _of(crawled.pages, "url", settled).select("url", F.lit(True).alias("found"), "kept")
    told = _but(told, changes).unionByName(present.select("url", F.lit(True).alias("found"), "kept"))
    fresh = settled.join(told, "url", "left").select("url", "depth", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("kept", F.lit(False)).alias("kept"))
    stayed = _but(_but(visited, lost), settled)
    # Pages that changed where they are: what the snapshot has of them.
    renewed = stayed.join(changes.select("url", F.lit(True).alias("changed"), F.col("kept").alias("now_kept")), "url", "left")
    changed = F.col("changed").isNotNull()
    return renewed.select(
        "url", "depth", F.when(changed, F.col("now_kept").isNotNull()).otherwise(F.col("found")).alias("found"),
        F.when(changed, F.coalesce("now_kept", F.lit(False))).otherwise(F.col("kept")).alias("kept")).unionByName(
        fresh.select("url", F.col("depth").cast("int").alias("depth"), "found", "kept"))
