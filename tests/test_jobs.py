"""Whole jobs over small trees, and the plans they run."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.plans.build import chunks_of, embed_chunks, load_model
from gleaner.plans.derived import documents as derived_documents
from gleaner.plans.jobs import chosen_checkouts, index_files, index_pages, index_tutorials
from gleaner.plans.search import search, search_text
from gleaner.sources import index

TREE = {
    "tool": {
        "src/solver.py": "adjoint solver loop", "doc/guide.md": "how to install the tool",
        "tests/run.py": "run the regression case", "tests/case/system/controls": "end time 100",
        "_build/guide.md": "copy", "empty.py": " ",
    },
    "extra": {"readme.md": "workshop examples", "build/x.py": "generated"},
    "heavy": {"mesh.cpp": "mesh library"},
}


@pytest.fixture(scope="module")
def checkouts(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("checkouts")
    for source, files in TREE.items():
        for path, text in files.items():
            (place / source / path).parent.mkdir(parents=True, exist_ok=True)
            (place / source / path).write_text(text)
    rows = [(source, str(place / source), "main") for source in TREE]
    return spark.createDataFrame(rows, "source string, root string, branch string")


def places(spark, root, name):
    return sorted(r.file_path or r.url for r in index.collection(spark, root, name).collect())


def test_jobs(spark, checkouts, tmp_path):
    root = str(tmp_path / "index")
    tool = checkouts.where("source = 'tool'")
    index_files(spark, root, tool, "code")
    first = load_model(spark, root)
    index_files(spark, root, tool, "docs")
    index_files(spark, root, tool, "tests", "rebuild")
    assert load_model(spark, root) == first  # the model is fitted once
    assert places(spark, root, "code") == ["src/solver.py", "tests/run.py"]
    assert places(spark, root, "docs") == ["doc/guide.md"]
    assert places(spark, root, "tests") == ["tests/case/system/controls", "tests/run.py"]
    index_files(spark, root, tool, "code", "refresh")
    assert len(places(spark, root, "code")) == 2
    index_files(spark, root, tool, "code", "append")
    assert len(places(spark, root, "code")) == 2  # what is present is not added again
    index_files(spark, root, checkouts.where("source <> 'extra'"), "code", "refresh")
    index_files(spark, root, tool, "code", "refresh")  # other sources stay
    assert places(spark, root, "code") == ["mesh.cpp", "src/solver.py", "tests/run.py"]

    registry = tmp_path / "sources.json"
    registry.write_text(json.dumps({"sources": [
        {"name": "extra", "url": "u", "category": "tutorials", "priority": 1},
        {"name": "heavy", "url": "u", "category": "prerequisite", "priority": 2},
    ]}))
    index_tutorials(spark, root, str(registry), checkouts)
    assert places(spark, root, "tutorials") == ["readme.md"]
    index_tutorials(spark, root, str(registry), checkouts, "rebuild", include_prerequisites=True)
    assert places(spark, root, "tutorials") == ["mesh.cpp", "readme.md"]

    asked = spark.createDataFrame(
        [("a", "code", "adjoint solver", 1), ("b", "tutorials", "workshop", None)],
        "query_id string, collection string, query string, n_results int")
    rendered = {r.query_id: r.rendered for r in search_text(spark, root, asked, first).collect()}
    assert rendered["a"].startswith("**src/solver.py** (score: ")
    assert rendered["b"].count("**") == 4
    tools = spark.createDataFrame(
        [("a", "search_codebase", "adjoint solver", 1), ("c", "search_all", "x", 1),
         ("d", "search_codebase", "adjoint", 0)],
        "query_id string, tool string, query string, n_results int")
    told = {r.query_id: r.rendered for r in search_text(spark, root, tools, first).collect()}
    assert told["a"] == rendered["a"]
    assert told["c"] == "Unknown tool: search_all"
    assert told["d"] == "No results found."
    with pytest.raises(ValueError, match="no documents"):
        index_files(spark, root, checkouts.where("source = 'heavy'"), "docs")


def test_page_job(spark, tmp_path):
    root = str(tmp_path)
    pages = spark.createDataFrame([
        ("https://s.org/", "<title>Home</title><body>" + "welcome " * 20 + "<a href='/a'>a</a></body>"),
        ("https://s.org/a", "<body>" + "details " * 20 + "</body>"),
        ("https://s.org/alone", "<body>" + "hidden " * 20 + "</body>"),
    ], "url string, html string")
    index_pages(spark, root, pages, spark.createDataFrame([("https://s.org/",)], "url string"))
    got = {r.url: (r.title, r.source) for r in index.collection(spark, root, "docs").collect()}
    assert got == {"https://s.org/": ("Home", "s.org"), "https://s.org/a": ("https://s.org/a", "s.org")}


def test_job_reports_and_unreadable_files(spark, tmp_path, monkeypatch):
    root, tree = str(tmp_path / "index"), tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    for name, text in {"a.py": "first file", "b.py": "second file", "c.py": "third file", "blank.py": " \n", "notes.md": "x"}.items():
        (tree / "src" / name).write_text(text)
    checkouts = spark.createDataFrame([("tool", str(tree), "main")], "source string, root string, branch string")
    first = index_files(spark, root, checkouts, "code")
    assert (first.loaded, first.skipped_type, first.skipped_blank, first.skipped_unreadable, first.n_skipped) == (3, 1, 1, 0, 2)
    assert (first.added, first.changed, first.removed, first.chunks) == (3, 0, 0, 3)
    assert [tuple(row) for row in first.skipped.collect()] == [("tool", "src/blank.py", "blank")]

    (tree / "src" / "a.py").write_text("first file, edited")
    (tree / "src" / "c.py").unlink()
    (tree / "src" / "b.py").unlink()
    (tree / "src" / "b.py").symlink_to("/proc/self/mem")  # listed, but not to be read
    second = index_files(spark, root, checkouts, "code", "refresh")
    assert (second.loaded, second.skipped_unreadable) == (1, 1)
    assert (second.added, second.changed, second.removed, second.chunks) == (0, 1, 1, -1)
    assert ("tool", "src/b.py", "unreadable") in [tuple(row) for row in second.skipped.collect()]
    held = {row.file_path: row.text for row in index.collection(spark, root, "code").collect()}
    assert held == {"src/a.py": "first file, edited", "src/b.py": "second file"}
    third = index_files(spark, root, checkouts, "code", "refresh")
    assert (third.added, third.changed, third.removed, third.chunks) == (0, 0, 0, 0)
    assert index.catalog(spark, root).first().n_chunks == 2


def test_chunk_options_reach_the_jobs(spark, tmp_path):
    root, tree = str(tmp_path / "index"), tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text(" ".join(f"w{at}" for at in range(30)))
    checkouts = spark.createDataFrame([("tool", str(tree), "main")], "source string, root string, branch string")
    assert index_files(spark, root, checkouts, "code", options=index.Options("window", 12, 4)).chunks == 4
    (tree / "b.py").write_text(" ".join(f"v{at}" for at in range(30)))
    assert index_files(spark, root, checkouts, "code", "refresh").chunks == 4
    assert index.versions(spark, root)["code"].options == index.Options("window", 12, 4)


def test_base_of_a_crawl(spark, tmp_path):
    body = "welcome to the guide " * 20
    pages = spark.createDataFrame([
        ("https://s.org/guide/", f"<body>{body}<a href='https://s.org/guide/a'>a</a><a href='https://s.org/blog'>b</a></body>"),
        ("https://s.org/guide/a", f"<body>{body}</body>"), ("https://s.org/blog", f"<body>{body}</body>"),
    ], "url string, html string")
    seeds = spark.createDataFrame([("https://s.org/guide/",)], "url string")
    report = index_pages(spark, str(tmp_path / "one"), pages, seeds, base=F.lit("https://s.org/guide"))
    assert (report.loaded, report.added) == (2, 2)
    assert index_pages(spark, str(tmp_path / "two"), pages, seeds).loaded == 3
    assert index_pages(spark, str(tmp_path / "three"), pages, seeds, max_depth=0).loaded == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_from_documents_to_vectors(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    documents = derived_documents(spark, "/root/testdata/sf0.001")
    documents.write.parquet(path)

    def factory():
        return lambda texts: None

    embedded = embed_chunks(chunks_of(spark.read.parquet(path)), factory, "m")
    assert "Exchange" not in plan(embedded)
    assert plan(embedded).count("ArrowEvalPython") == 1
    narrow = plan(chunks_of(spark.read.parquet(path)).select("doc_key", "chunk_no"))
    assert "ReadSchema: struct<doc_key:string,text:string>" in narrow


def test_winners_are_broadcast_to_the_text_scan(spark, checkouts, tmp_path):
    root = str(tmp_path)
    index_files(spark, root, checkouts.where("source = 'tool'"), "code")
    asked = spark.createDataFrame(
        [("a", "code", "solver", 1)], "query_id string, collection string, query string, n_results int")
    hits = search(spark, root, asked, load_model(spark, root))
    text = plan(hits.select("query_id", "text"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "embedding" not in text
    assert "PartitionFilters: [isnotnull(collection" in text and "IN (code)" in text or "= code)" in text
    assert hits.select(F.col("label")).first().label == "src/solver.py"


def test_one_branch_per_source(spark):
    rows = [("a", "/1", "work", True), ("a", "/2", "master", False), ("b", "/3", "dev", True), ("b", "/4", "old", False),
            ("c", "/5", "main", False)]
    checkouts = spark.createDataFrame(rows, "source string, root string, branch string, active boolean")
    roots = [row.root for row in chosen_checkouts(checkouts).orderBy("root").collect()]
    assert roots == ["/2", "/3", "/5"]
    assert chosen_checkouts(checkouts.drop("active")).count() == 3
