import pytest

from graphloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare

from .conftest import SF


def test_ten_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""
