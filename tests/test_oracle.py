"""Every registered query runs; those with SQL give the rows DuckDB gives."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, duck
from modelscout.oracle import ORACLE
from modelscout.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    _, problems = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert not problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 11


def test_sql_only_for_queries():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())
