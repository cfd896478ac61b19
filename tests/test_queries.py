"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# Slow iterative fits are covered by test_models.py.
ROWS_ONLY = sorted(set(entry.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(SQL[name]).df()) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_ranks_the_models(spark):
    table = entry.entry(spark).toPandas().sort_values("rank")
    assert list(table["rank"]) == [1, 2, 3]
    assert table["rmse"].is_monotonic_increasing
