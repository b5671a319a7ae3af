import pytest

from conftest import DATA, same_as_oracle
from foliomill.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same_as_oracle(spark, name, QUERIES, ORACLE_SQL)


def test_all_problems_have_a_query():
    assert {int(n[1:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
