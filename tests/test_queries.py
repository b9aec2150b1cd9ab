import pytest

from graphloom import queries_code  # noqa: F401
from graphloom.queries import ORACLE_SQL, QUERIES

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLE_SQL[name]) == ""


def test_bundle_keeps_its_budget(spark):
    rows = QUERIES["context_bundle"](spark, SF).orderBy("position").collect()
    assert rows and rows[0]["selection_reason"].startswith("seed,depth=0") and sum(r["tokens"] for r in rows) <= 600
