"""Row predicates that decide which files, pages and sources are indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import path_parts, suffix
from gleaner.schema import DEFAULT_MAX_PRIORITY, DEFAULT_PRIORITY, MIN_PAGE_CHARS

# Extensions per collection; case matters (.C and .H are C++).
CODE_SUFFIXES = (".py", ".C", ".H", ".cpp", ".h", ".c", ".yml", ".yaml", ".cfg", ".conf")
DOC_SUFFIXES = (".rst", ".md")
TEST_SUFFIXES = (".py",)
TUTORIAL_SUFFIXES = (
    ".py", ".c", ".cpp", ".h", ".hpp", ".C", ".H", ".md", ".rst", ".txt", ".yaml", ".yml",
    ".json", ".cfg", ".conf", ".sh", ".mk", ".cmake",
)

# Directories whose content is never indexed.
DOC_SKIP_DIRS = ("_build", "_static", "_images", ".git")
TUTORIAL_SKIP_DIRS = (
    ".git", ".github", ".idea", ".vscode", "build", "dist", "__pycache__", ".pytest_cache",
)

# What makes a file a solver configuration.
CASE_DIRS = ("constant", "system", "0")
CASE_SUFFIXES = ("", ".cfg", ".foam", ".txt")

TEST_ROOT = "tests/"


def has_suffix(path: Column, allowed: tuple[str, ...]) -> Column:
    return suffix(path).isin(*allowed)


def has_part(path: Column, names: tuple[str, ...]) -> Column:
    """Any part of the path, the file name included, is one of ``names``."""
    return F.arrays_overlap(path_parts(path), F.array(*[F.lit(name) for name in names]))


def is_case_config(path: Column) -> Column:
    return has_part(path, CASE_DIRS) & has_suffix(path, CASE_SUFFIXES)


def is_code_file(path: Column) -> Column:
    return has_suffix(path, CODE_SUFFIXES)


def is_doc_file(path: Column) -> Column:
    return has_suffix(path, DOC_SUFFIXES) & ~has_part(path, DOC_SKIP_DIRS)


def under_tests(path: Column) -> Column:
    return F.startswith(path, F.lit(TEST_ROOT))


def is_test_file(path: Column) -> Column:
    """Python, or solver configuration, below ``tests/``."""
    return under_tests(path) & (has_suffix(path, TEST_SUFFIXES) | is_case_config(path))


def is_tutorial_file(path: Column) -> Column:
    return has_suffix(path, TUTORIAL_SUFFIXES) & ~has_part(path, TUTORIAL_SKIP_DIRS)


def long_enough(main_text: Column) -> Column:
    """False, never NULL, for short and for missing main text."""
    return F.coalesce(F.length(main_text) >= MIN_PAGE_CHARS, F.lit(False))


def select_sources(
    registry: DataFrame,
    max_priority: int = DEFAULT_MAX_PRIORITY,
    include_prerequisites: bool = False,
) -> DataFrame:
    """Registry entries up to a priority; prerequisites only on request."""
    wanted = F.coalesce("priority", F.lit(DEFAULT_PRIORITY)) <= max_priority
    if not include_prerequisites:
        wanted &= ~F.col("category").eqNullSafe("prerequisite")
    return registry.where(wanted)
