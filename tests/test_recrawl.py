"""Depths kept up to date, against a full crawl after each change."""

import random

from gleaner.operators.crawl import reachable
from gleaner.operators.recrawl import Crawled, links_of, recrawl
from gleaner.session import stored

PAGE = "url string, kept boolean, targets array<string>"


def frame(spark, pages):
    return stored(spark.createDataFrame([(url, *page) for url, page in pages.items()], PAGE), "pages")


def crawl(spark, pages, seeds):
    table = frame(spark, pages)
    return Crawled(table, stored(links_of(table), "links"), seeds, stored(reachable(table, seeds), "visited"))


def brute(pages, seeds):
    depth, frontier = {url: 0 for url in seeds}, list(seeds)
    while frontier:
        new = []
        for url in frontier:
            kept, targets = pages.get(url, (False, []))
            for target in targets if kept else []:
                if target not in depth:
                    depth[target] = depth[url] + 1
                    new.append(target)
        frontier = new
    return sorted((url, at, url in pages, bool(pages.get(url, (False,))[0])) for url, at in depth.items())


def rows(found):
    return sorted((r.url, r.depth, r.found, r.kept) for r in found.collect())


def changed(spark, before, after):
    told = [(url, *after.get(url, (None, None))) for url in set(before) | set(after) if before.get(url) != after.get(url)]
    return spark.createDataFrame(told, PAGE)


def test_changes_of_a_small_graph(spark):
    # A chain with a short cut, a cycle, a page that is not followed, and a page alone.
    pages = {"a": (True, ["b", "x"]), "b": (True, ["c"]), "c": (True, ["d", "a"]), "d": (True, ["e"]), "e": (True, ["c"]),
             "x": (False, ["y"]), "alone": (True, ["z"])}
    seeds = spark.createDataFrame([("a",)], "url string")
    done = crawl(spark, pages, seeds)
    assert rows(done.visited) == brute(pages, ["a"])
    for change in (
        {"b": None, "x": (True, ["y", "e"])},  # a page goes, another one is followed now: the cycle is entered elsewhere
        {"a": (True, ["b", "x", "alone", "d"]), "z": (True, ["a"])},  # short cuts, and a page that appears
    ):
        after = {url: page for url, page in (pages | change).items() if page is not None}
        assert rows(recrawl(done, changed(spark, pages, after))) == brute(after, ["a"]), change


def test_random_changes_equal_a_full_crawl(spark):
    rng = random.Random(12)

    def page(n):
        return rng.random() < 0.9, sorted({f"u{rng.randrange(n)}" for _ in range(rng.randrange(4))})

    pages = {f"u{at}": page(70) for at in range(60)}
    seeds = spark.createDataFrame([("u0",), ("u7",)], "url string")
    done = crawl(spark, pages, seeds)
    after = dict(pages)
    for at in rng.sample(range(70), 12):
        if rng.random() < 0.3:
            after.pop(f"u{at}", None)
        else:
            after[f"u{at}"] = page(70)
    assert rows(recrawl(done, changed(spark, pages, after))) == brute(after, ["u0", "u7"])


def test_untouched_pages_are_not_read(spark, monkeypatch):
    pages = {f"u{at}": (True, [f"u{at + 1}"]) for at in range(40)} | {f"v{at}": (True, [f"v{at + 1}"]) for at in range(40)}
    seeds = spark.createDataFrame([("u0",), ("v0",)], "url string")
    done = crawl(spark, pages, seeds)
    asked = set()
    from gleaner.operators import recrawl as module

    look_up = module._of

    def noted(table, key, urls):
        asked.update(row.url for row in urls.collect())
        return look_up(table, key, urls)

    monkeypatch.setattr(module, "_of", noted)
    after = pages | {"u37": (True, [])}
    assert rows(recrawl(done, changed(spark, pages, after))) == brute(after, ["u0", "v0"])
    assert asked <= {f"u{at}" for at in range(36, 42)}
