"""Every value-checked query against its DuckDB SQL at sf0.01."""

import pytest

from conftest import SF01
from oracle_check import compare, duck

import __spark_entry__ as E


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], con, SF01)
    assert r["cols"] and r["count"] and r["hash"], (r["scols"], r["dcols"], r["rows"], r["duck_rows"])
    assert not r["types"], r["types"]
