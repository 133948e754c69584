import os

import pytest

from foliant.llm.queries import ORACLE_SQL, QUERIES

from ..compare import differences

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    only_spark, only_sql, rows = differences(spark, QUERIES[name], ORACLE_SQL[name], DATA)
    assert (only_spark, only_sql) == ([], []) and rows > 0


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_shares_are_those_of_the_verdicts(spark):
    found = {(r.table_name, r.ord) for r in QUERIES["p4_found"](spark, DATA).collect()}
    shares = QUERIES["p4_shares"](spark, DATA).collect()
    assert sum(r.cut_values for r in shares) == len(found)
    for r in shares:
        assert r.cut_share == pytest.approx(r.cut_values / r["values"], abs=1e-4)


@needs_data
def test_items_count_the_documents_found(spark):
    found = QUERIES["p8_found"](spark, DATA).collect()
    items = {r.item_id: r.documents - r.reparameterised for r in QUERIES["p8_items"](spark, DATA).collect()}
    counted: dict[int, int] = {}
    for r in found:
        counted[r.item_id] = counted.get(r.item_id, 0) + 1
    assert counted == {k: v for k, v in items.items() if v}
