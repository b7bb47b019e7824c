"""Every registered query against its oracle in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from tests.conftest import DATA
from tidemark.plans import catalogue
from tidemark.sources.tables import TABLES

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return out


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(table, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in table.to_pylist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, con, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert rows_of(got.toArrow(), columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_filters_reach_the_scan_and_scans_are_narrow(spark):
    rows = QUERIES["time_range_scan"](spark, DATA)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
