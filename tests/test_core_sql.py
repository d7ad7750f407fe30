import pytest
from conftest import same_rows

from sparkquarry.plans import core, core_sql


@pytest.mark.parametrize("name", sorted(core_sql.oracle_sql()))
def test_query_equals_sql(name, spark, data, duck):
    same_rows(core.queries()[name](spark, data), duck.execute(core_sql.oracle_sql()[name]).df())


def test_every_query_has_sql():
    assert set(core.queries()) == set(core_sql.oracle_sql())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
