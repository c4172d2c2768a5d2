"""Every registered query with SQL gives the SQL's rows."""

import os

import pytest

from arbolex.plans import indexed, registry, vocabulary  # noqa: F401

from .compare import connection, differences

DIR = os.environ.get("ARBOLEX_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connection(DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, con, name):
    assert name in registry.ORACLES
    assert differences(spark, con, DIR, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_prefix_is_pushed_down(spark):
    df = registry.QUERIES["prefix_page"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,red)" in plan and "TakeOrderedAndProject" in plan


def test_queries_read_the_kept_index(spark):
    """Neither a phrase's statistics nor its filter tokenise again."""
    df = registry.QUERIES["fts_phrase"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("\n") if "InMemoryTableScan" in line]
    assert len(above) >= 2 and all("octet_length" not in line for line in above)
