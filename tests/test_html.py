"""The page reader against hand-made pages and against the standard library's parser."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleaner.functions.html import read_page, simple_hrefs, simple_main_text
from gleaner.operators import crawl
from gleaner.operators.crawl import reachable
from gleaner.operators.documents import documents_from_pages
from gleaner.operators.pages import distinct_targets, page_links, parse_pages

PAGES = "/root/testdata/sf0.001/pages.parquet"
LONG = "x" * 100


@pytest.mark.parametrize("page, text", [
    ('<body><article>a</article><div role="main">m</div></body>', "m"),
    ("<body>b<article>a</article></body>", "a"),
    ("<body> b <p>c</p>\n</body>", "b\nc"),
    ("<p>nothing</p>", None),
    ("", None),
    ("<body><article>a<article>n</article>t</article><article>2</article></body>", "a\nn\nt"),
    ("<div role=main>x<div>y</div>z</div>w", "x\ny\nz"),
    ("<body>a<script>if (a<b) {'</p>'}</script>b<style>p{}</style><!-- <article>c</article> -->d</body>", "a\nb\nd"),
    ("<body>&lt;i&gt; &amp; &eacute;&#233;&nbsp;</body>", "<i> & éé"),
    ("<body>a<br>b<img src='x'/>c</body>", "a\nb\nc"),
    ("<body><template>t<p>u</p></template>v</body>", "v"),
    ("<ARTICLE CLASS='k'>up</ARTICLE>", "up"),
    ("<div><article>in</div>out", "in"),
    ("<body>3 < 4 and x > y</body>", "3 < 4 and x > y"),
    ('<body><a title="a>b" href="/k">l</a></body>', "l"),
    ("<body>never closed <b>bold", "never closed\nbold"),
    ("<body><a title=it's href=/x>l</a> it's</body>", "l\nit's"),
    ("<body>" + "<a " * 100_000, ("<a " * 100_000).strip()),
    ("<body/>x", ""),
])
def test_main_text(page, text):
    assert read_page(page)[0] == text


def test_title_and_links():
    assert read_page("<p>x</p>")[1] is None
    assert read_page("<title></title>")[1] == ""
    assert read_page("<title> T &amp; U </title><title>2</title>")[1] == "T & U"
    page = '<a href="/a?x=1&amp;y">1</a><A HREF=\'b\'>2</A><a name="n">3</a><a href=c>4</a><a href>5</a>'
    assert read_page(page)[2] == ["/a?x=1&y", "b", "c", ""]


class Plain(HTMLParser):
    """Text of the first article, by the standard library, for pages with one article."""

    def __init__(self):
        super().__init__()
        self.inside = False
        self.run, self.nodes, self.hrefs = "", [], []

    def flush(self):
        if self.run.strip():
            self.nodes.append(self.run.strip())
        self.run = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.inside |= tag == "article"
        self.hrefs += [value for name, value in attrs if tag == "a" and name == "href"]

    def handle_endtag(self, tag):
        self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.run += data


def test_snapshot_like_standard_parser(spark):
    pages = spark.read.parquet(PAGES).collect()
    for page in pages:
        plain = Plain()
        plain.feed(page.html)
        text, _, hrefs = read_page(page.html)
        assert text == "\n".join(plain.nodes)
        assert hrefs == plain.hrefs


def test_simple_expressions_agree_on_plain_markup(spark):
    pages = spark.read.parquet(PAGES)
    parsed = parse_pages(pages).select("page_id", "main_text")
    simple = pages.select("page_id", simple_main_text(F.col("html")).alias("simple"))
    assert parsed.join(simple, "page_id").where("main_text <> simple").count() == 0
    hrefs = pages.select(F.size(simple_hrefs(F.col("html"))).alias("n")).agg(F.sum("n")).first()[0]
    assert hrefs == sum(len(read_page(p.html)[2]) for p in pages.collect())


def make_pages(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_minimum_length_drops_page_and_links(spark):
    def page(length):
        return f"<body>{'x' * length}<a href='/n'></a></body>"

    parsed = parse_pages(make_pages(spark, [
        ("https://s.org/99", page(99)), ("https://s.org/100", page(100)), ("https://s.org/none", "<p>x</p>"),
    ]))
    assert {r.src_url for r in page_links(parsed).collect()} == {"https://s.org/100"}
    documents = documents_from_pages(parsed, F.lit("s.org"))
    assert [(r.url, r.title) for r in documents.collect()] == [("https://s.org/100", "https://s.org/100")]


def test_crawl(spark):
    """seed to A to B and back; D behind a short page; C isolated; E not in the snapshot."""
    def page(*links, text=LONG):
        return "<body>" + text + "".join(f'<a href="{link}">l</a>' for link in links) + "</body>"

    site = "https://s.org"
    pages = make_pages(spark, [
        (f"{site}/", page("/A", "/short", "//other.org/x", "/A#part")),
        (f"{site}/A", page("/B", "/")),
        (f"{site}/B", page(f"{site}/", "/E?q=1")),
        (f"{site}/C", page("/D")),
        (f"{site}/D", page()),
        (f"{site}/short", page("/D", text="brief")),
    ])
    parsed = parse_pages(pages)
    seeds = spark.createDataFrame([(f"{site}/",)], "url string")
    got = {r.url.removeprefix(site): (r.depth, r.found, r.kept) for r in reachable(parsed, seeds).collect()}
    assert got == {
        "/": (0, True, True), "/A": (1, True, True), "/short": (1, True, False),
        "/B": (2, True, True), "/E": (3, False, False),
    }
    limited = reachable(parsed, seeds, max_depth=1)
    assert {r.url.removeprefix(site) for r in limited.collect()} == {"/", "/A", "/short"}
    assert distinct_targets(parsed).where(F.col("dst_url") == f"{site}/A").count() == 1


def test_few_urls_read_their_buckets_only(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame([(f"u{at}", True, [f"u{(at * 7 + 1) % 90}", f"u{at + 1}"]) for at in range(80)],
                                  "url string, kept boolean, targets array<string>")
    seeds = spark.createDataFrame([("u3",), ("u50",)], "url string")
    whole = sorted(map(tuple, crawl.reachable(pages, seeds).collect()))
    monkeypatch.setattr(crawl, "LARGE_TABLE", 0)
    assert sorted(map(tuple, crawl.reachable(pages, seeds).collect())) == whole
    monkeypatch.setattr(crawl, "FEW_URLS", 4)  # rounds of more URLs scan the table
    assert sorted(map(tuple, crawl.reachable(pages, seeds).collect())) == whole
    pages.write.bucketBy(8, "url").sortBy("url").option("path", str(tmp_path / "t")).saveAsTable("few_urls")
    try:
        plan = crawl.part_of(spark.table("few_urls"), seeds)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE few_urls")
    assert "PushedFilters: [In(url, [u3,u50])]" in plan
