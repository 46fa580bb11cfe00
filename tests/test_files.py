"""File scans, classification, registries and ingest counts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators.documents import (
    documents_from_files, file_outcomes, ingest_stats, preferred_branch, registry_defaults, with_registry,
)
from gleaner.operators.filters import is_code_file, select_sources
from gleaner.sources.files import list_files, read_files, read_pieces, scan_files
from gleaner.sources.registry import scan_registry

# path: the collections that take it (c code, d docs, t tests, u tutorials)
TAKEN = {
    "pkg/__init__.py": "cu", "src/Solver.C": "cu", "src/solver.c": "cu", "src/x.hpp": "u",
    "doc/a.rst": "du", "_build/a.rst": "u", "build/a.py": "c", "tests/run.py": "ctu",
    "tests/case/system/controls": "t", "tests/case/constant/a.cfg": "ctu",
    "tests/case/system/gen.py": "ctu", "tests/case/0.orig/U": "", "tests/case/0/T": "t",
    "tests/system": "t", "case/system/controls": "", "README": "", ".gitignore": "",
    "b.py": "cu", "x.py/y": "",
}
NAMES = {"c": "code", "d": "docs", "t": "tests", "u": "tutorials"}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("s", "main", path, bytearray(b" text \n")) for path in TAKEN]
    rows += [("s", "main", "a.py", bytearray(b"  \n")), ("s", "main", "lost.py", None)]
    frame = spark.createDataFrame(rows, "source string, branch string, file_path string, content binary")
    bad = F.when(F.col("file_path") == "b.py", F.lit(bytearray(b"ok\xff\xfe"))).otherwise(F.col("content"))
    return frame.withColumn("content", bad)


@pytest.fixture(scope="module")
def registered(spark, files):
    registry = spark.createDataFrame([("s", "u", None, None, 1)], "name string, url string, branch string, category string, priority int")
    return with_registry(files, registry)


@pytest.mark.parametrize("letter", "cdtu")
def test_who_takes_what(files, registered, letter):
    source = registered if letter == "u" else files
    taken = {r.file_path for r in documents_from_files(source, NAMES[letter]).collect()}
    assert taken == {path for path, who in TAKEN.items() if letter in who}


def test_one_scan_for_all_collections(files, registered):
    every = documents_from_files(registered, *NAMES.values())
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # the files, and the registry
    got = {(r.collection, r.file_path) for r in every.collect()}
    assert got == {(NAMES[letter], path) for path, who in TAKEN.items() for letter in who}
    others = with_registry(files, registered.limit(0).selectExpr(
        "source name", "'' url", "branch", "category", "priority"), keep_others=True)
    assert documents_from_files(others, "tutorials").count() == 0


def test_test_metadata(files):
    got = {r.file_path: (r.doc_type, r.language) for r in documents_from_files(files, "tests").collect()}
    assert got["tests/run.py"] == ("python_test", "py")
    assert got["tests/case/system/gen.py"] == ("python_test", "py")
    assert got["tests/case/system/controls"] == ("openfoam_config", "openfoam")
    assert got["tests/case/constant/a.cfg"] == ("openfoam_config", "cfg")


def test_text_and_metadata(files, registered):
    code = {r.file_path: r for r in documents_from_files(files, "code").collect()}
    assert code["b.py"].text == "ok\ufffd\ufffd"
    assert code["src/Solver.C"].text == " text \n"
    assert (code["src/Solver.C"].repo, code["src/Solver.C"].branch, code["src/Solver.C"].language) == ("s", "main", "C")
    docs = documents_from_files(files, "docs").first()
    assert (docs.text, docs.format, docs.source) == ("text", "rst", "s")
    tutorial = documents_from_files(registered, "tutorials").first()
    assert (tutorial.repo, tutorial.category, tutorial.priority, tutorial.source) == ("s", "tutorials", 1, "repo_sources")


def test_outcomes_and_counts(files):
    outcomes = {r.file_path: r.code for r in file_outcomes(files, "code").collect()}
    assert outcomes["a.py"] == "blank" and outcomes["lost.py"] == "unreadable" and outcomes["README"] == "type"
    row = ingest_stats(files, "code").first()
    loaded = sum("c" in who for who in TAKEN.values())
    assert (row.loaded, row.skipped_blank, row.skipped_unreadable) == (loaded, 1, 1)
    assert row.loaded + row.skipped == len(TAKEN) + 2
    tests = ingest_stats(files, "tests").first()
    assert tests.loaded + tests.skipped == sum(p.startswith("tests/") for p in TAKEN)


def test_preferred_branch(spark):
    rows = [("a", "main", False), ("a", "master", True), ("b", "master", False), ("b", "x", True),
            ("c", "x", True), ("c", "y", False)]
    got = preferred_branch(spark.createDataFrame(rows, "source string, branch string, active boolean"))
    assert {r.source: r.branch for r in got.collect()} == {"a": "main", "b": "master", "c": "x"}


def registry_entries():
    counts = [("tutorials", 1, 1), ("tests", 1, 1), ("docs", 1, 1), ("validation", 2, 2), ("tutorials", 2, 1),
              ("prerequisite", 2, 2), ("prerequisite", 3, 12)]
    return [
        {"name": f"o{i}/{category}{n}{priority}", "url": "u", "branch": "main", "category": category, "priority": priority}
        for i, (category, priority, many) in enumerate(counts) for n in range(many)
    ]


@pytest.mark.parametrize("priority, prerequisites, selected", [
    (1, False, 3), (2, False, 6), (2, True, 8), (3, False, 6), (3, True, 20),
])
def test_registry_selection(spark, tmp_path, priority, prerequisites, selected):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({"version": 1, "sources": registry_entries()}, indent=1))
    entries = scan_registry(spark, str(path))
    assert entries.count() == 20
    assert select_sources(entries, priority, prerequisites).count() == selected


def test_registry_gaps(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({"sources": [
        {"name": "a/b", "url": "u", "priority": 1}, {"name": "no-priority", "url": "u", "category": "docs"},
    ]}))
    row = registry_defaults(select_sources(scan_registry(spark, str(path)))).collect()
    assert [(r.name, r.branch, r.category, r.priority, r.source_key) for r in row] == [
        ("a/b", "main", "tutorials", 1, "a__b")]
    path.write_text("{}")
    assert scan_registry(spark, str(path)).count() == 0


def test_scan_keeps_hidden_names_and_reads_late(spark, tmp_path):
    contents = {
        "_build.py": b"1", ".hid.py": b"2", "_x/b.py": b"3", ".hid/deep/er/a.py": b"4",
        "top.py": b"5", "skip.bin": b"6", "empty.py": b"",
    }
    for path, content in contents.items():
        place = tmp_path / "tree" / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(content)
    (tmp_path / "tree" / "loop").symlink_to(tmp_path / "tree")
    roots = spark.createDataFrame(
        [("s", str(tmp_path / "tree"))], "source string, root string")
    listed = list_files(roots)
    assert {(r.file_path, r.size) for r in listed.collect()} == {(p, len(c)) for p, c in contents.items()}
    read = scan_files(roots, is_code_file(F.col("file_path"))).collect()
    assert {r.file_path: bytes(r.content) for r in read} == {p: c for p, c in contents.items() if p.endswith(".py")}
    uri = spark.createDataFrame([("s", f"file://{tmp_path}/tree/")], "source string, root string")
    assert {r.file_path for r in scan_files(uri).collect()} == set(contents)
    os.remove(tmp_path / "tree" / "top.py")
    late = {r.file_path: r.content for r in read_files(listed).collect()}
    assert late["top.py"] is None and late["empty.py"] == b""


def test_a_missing_root_is_an_error(spark, tmp_path):
    roots = spark.createDataFrame([("one", str(tmp_path / "absent"))], "source string, root string")
    with pytest.raises(Exception, match="absent"):
        scan_files(roots).collect()


def test_pieces_cover_every_file_and_errors_are_rows(spark, tmp_path):
    contents = {"a.bin": bytes(range(256)) * 41, "empty.txt": b"", "one.txt": b"x", "deep/b.txt": b"0123456789" * 3}
    (tmp_path / "deep").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    for name in ("gone.txt", "cut.txt"):
        (tmp_path / name).write_bytes(b"0123456789abc")
    listed = list_files(spark.createDataFrame([("s", str(tmp_path))], "source string, root string"))
    listed.collect()
    os.unlink(tmp_path / "gone.txt")
    (tmp_path / "cut.txt").write_bytes(b"0123456")
    for size in (1, 10, 64, 1 << 20):
        found = {}
        for row in read_pieces(listed, F.col("size") < 100 if size == 1 else None, size).collect():
            assert (row.content is None) == (row.error is not None)
            assert len(row.content or b"") <= size
            assert (row.file_path, row.start) not in found
            found[row.file_path, row.start] = row.content
        for name, content in contents.items():
            if size > 1 or len(content) < 100:
                pieces = sorted((start, piece) for (path, start), piece in found.items() if path == name)
                assert b"".join(piece for _, piece in pieces) == content
                assert [start for start, _ in pieces] == list(range(0, max(1, len(content)), size))
        assert {piece for (path, _), piece in found.items() if path == "gone.txt"} == {None}
        assert None in {piece for (path, _), piece in found.items() if path == "cut.txt"}
    assert read_pieces(listed.limit(0)).count() == 0
    with pytest.raises(ValueError):
        read_pieces(listed, piece_bytes=0)
