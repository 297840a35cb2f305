"""Every registered query against its DuckDB twin at sf0.01 (the driver's correctness gate)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_check import compare, duck

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["qid", "id", "d", "rk"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF_CHECK, name, QUERIES[name], SQL[name], con)
    assert r["status"] == "ok", r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
