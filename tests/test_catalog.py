import pytest

from textquarry.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(name, same_as_sql, medium):
    same_as_sql(QUERIES[name], ORACLE_SQL[name], medium)


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) == 5
