"""Every registered query with an oracle equals its DuckDB SQL at sf0.01
(columns, row count, multiset of rows, column types)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    assert r["ok"], r.get("why")
    assert not r.get("types"), r["types"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
