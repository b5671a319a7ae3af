import pytest

from conftest import DATA, same_as_oracle
from foliomill.plans.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_as_oracle(spark, name, QUERIES, ORACLE_SQL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
