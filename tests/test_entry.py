import os

import pytest

import __spark_entry__ as entry
from foliant.plans.registry import CORE_ORACLE_SQL, CORE_QUERIES

from .compare import differences

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE_ORACLE_SQL) <= set(CORE_QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(CORE_ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    only_spark, only_sql, rows = differences(spark, CORE_QUERIES[name], CORE_ORACLE_SQL[name], DATA)
    assert (only_spark, only_sql) == ([], []) and rows > 0


@needs_data
@pytest.mark.parametrize("name", sorted(set(CORE_QUERIES) - set(CORE_ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    assert CORE_QUERIES[name](spark, DATA).count() > 0
