import pytest
from compare import connected, differences

import tracespark.plans as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert not differences(plans.QUERIES[name](spark, FOLDER), con, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
