import pytest

import __spark_entry__ as entry
from lodestone.plans.queries import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_own_query_is_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
