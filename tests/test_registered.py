"""Every registered query against its SQL on the smallest folder."""

import oracle
import pytest

import __spark_entry__ as entry
from boxloom.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert oracle.compare(found, duck, SQL[name]) == ""


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["items"] == row["items_identical"] + row["items_disputed"]
