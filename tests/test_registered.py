"""Every registered query against its SQL, in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TYPES, canonical_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    got = canonical_rows(frame.columns, [tuple(row) for row in frame.collect()])
    assert got
    if name in oracle_sql():
        result = duck.execute(oracle_sql()[name])
        types = {column[0]: str(column[1]) for column in result.description}
        want = canonical_rows(list(types), result.fetchall())
        assert {column: TYPES[kind] for column, kind in frame.dtypes} == types
        assert got == want


def test_sql_only_for_registered_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
