"""Every registered query against its DuckDB statement."""

from __future__ import annotations

import duckdb
import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir) -> duckdb.DuckDBPyConnection:
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, connection, sf_dir, name):
    assert compare(spark, connection, name, QUERIES[name], SQL.get(name), sf_dir) is None


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
