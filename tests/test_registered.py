"""Every registered query against its SQL, on the smallest data set."""
import pytest

import __spark_entry__ as entry
from basketry.registry.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 100


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and df.columns[0] == "category"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    difference = compare(QUERIES[name](spark, SF), con, SQL[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
