"""Text, path, URL and query expressions against hand-made cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import queries as q
from gleaner.functions import text as t
from gleaner.functions import urls as u


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def python_suffix(path):
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return name[dot:] if 0 < dot < len(name) - 1 else ""


PATHS = [
    "a.tar.gz", "a.", "..a", ".a.b", "a..", "T.orig", "a b.h", "README", ".gitignore", "x/y.C",
    "dir.d/file", "x/..", "", "pkg/__init__.py",
]


def test_suffix(spark):
    assert column(spark, PATHS, t.suffix) == [python_suffix(p) for p in PATHS]


def test_language_tag(spark):
    assert column(spark, ["a.py", "system/controls"], lambda x: t.language_tag(x, "openfoam")) == ["py", "openfoam"]
    assert column(spark, ["a.py", "b"], t.language_tag) == ["py", ""]


def test_decode_like_python(spark):
    raw = [b"ok\xff\xfe", b"\xc3", b"\xe2\x82", b"a\xf0\x9f\x98b", "é€😀".encode(), b"", b"\xed\xa0\x80x"]
    assert column(spark, raw, t.decode_utf8, "binary") == [r.decode("utf-8", "replace") for r in raw]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(t.WHITESPACE + "ab\u200b\x00")), max_size=8), min_size=20, max_size=40))
def test_strip_like_python(spark, values):
    assert column(spark, values, t.strip) == [v.strip() for v in values]


def test_relative_path_and_source_key(spark):
    def rel(root):
        return lambda x: t.relative_path(x, F.lit(root))

    assert column(spark, ["/a/b/c.py"], rel("/a")) == ["b/c.py"]
    assert column(spark, ["/a/b/c.py"], rel("/a/")) == ["b/c.py"]
    assert column(spark, ["C:\\r\\b\\c.py"], rel("C:\\r")) == ["b/c.py"]
    assert column(spark, ["team/tool"], t.source_key) == ["team__tool"]


def test_scope_and_canonical_form(spark):
    base = "https://site.org/"
    cases = {
        "/a": "https://site.org/a",
        "//h/a": None,
        "a.html": None,
        "https://site.org/a": "https://site.org/a",
        "https://other.org/a": None,
        "/a?x=1#t": "https://site.org/a",
        "/a#t?x": "https://site.org/a",
        "#top": None,
        "/": "https://site.org/",
    }
    assert column(spark, list(cases), lambda x: u.in_scope(x, F.lit(base))) == list(cases.values())
    assert column(spark, ["http://h.org:80/a/b?c#d", "https://h.org"], u.site_base) == [
        "http://h.org:80/", "https://h.org/"]


@pytest.mark.parametrize("model, prefix", [
    ("mixedbread-ai/mxbai-embed-large", q.SENTENCE_PREFIX), ("MXBAI-e5", q.SENTENCE_PREFIX),
    ("intfloat/E5-base", q.QUERY_PREFIX), ("thenlper/gte-large", q.QUERY_PREFIX),
    ("Snowflake/snowflake-arctic-embed-l", q.QUERY_PREFIX), ("BAAI/bge-m3", ""), ("gtelarge", ""),
])
def test_query_prefix(spark, model, prefix):
    assert column(spark, ["how?"], lambda x: q.format_query(x, F.lit(model))) == [prefix + "how?"]


def test_result_count(spark):
    assert column(spark, [None, 50, 20, 5, 1, 0, -1], q.result_count, "int") == [5, 20, 20, 5, 1, 0, 0]


def test_score(spark):
    assert column(spark, [0.0, 2.0, 4.0, 0.12349], q.score, "double") == [1.0, -1.0, -3.0, 0.877]


def test_label_and_rendering(spark):
    rows = spark.createDataFrame(
        [(0, "f", "u", "s", "python_test"), (1, "", "u", "s", ""), (2, None, None, "s", None),
         (3, None, "", None, None), (4, "", "", "", None)],
        "i int, file_path string, url string, source string, doc_type string",
    ).withColumn("label", q.hit_label(F.col("file_path"), F.col("url"), F.col("source"), F.col("doc_type")))
    labels = [r.label for r in rows.orderBy("i").collect()]
    assert labels == ["f  [python_test]", "u", "s", "?", ""]
    block = spark.range(1).select(q.render_hit(F.lit("f"), F.lit(0.5), F.lit("\n x \n")).alias("b")).first().b
    assert block == "**f** (score: 0.5)\n```\nx\n```"


def test_tool_collection(spark):
    tools = ["search_codebase", "search_docs", "search_tests", "search_tutorials", "search_moon", None]
    assert column(spark, tools, q.tool_collection) == ["code", "docs", "tests", "tutorials", None, None]
