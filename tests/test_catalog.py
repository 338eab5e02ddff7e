"""Every registered reference query against its SQL, and the driver contract."""

import pytest

from strataloom.plans import catalog
from tests.oracle import connect, same_rows

SLOW = {"scc_sizes", "cycles"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        same_rows(df, con, sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, sf):
    from strataloom.sources.tables import spans

    df = spans(spark, sf).where("user_id = 3").select("span_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "value" not in plan.split("ReadSchema")[1]
