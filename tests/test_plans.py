"""Physical-plan checks for the scale rules (sf0.001 tables)."""

import os

import pytest

import __spark_entry__ as E
from sparkcast import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

NO_PLAN = {"rf_forecast", "rf_importance", "rf_weighted_mean", "url_stream_dedupe"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - NO_PLAN))
def test_no_cartesian_products(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()
    plan = _plan(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_event_scan_prunes_and_pushes(spark):
    from sparkcast.plans import standins as S
    ev = S.events(spark, SF)
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_totalprice" not in plan          # unused columns are not read


def test_topk_has_partial_group_limit(spark):
    df = E.queries()["article_topk"](spark, SF)
    df.collect()
    assert "WindowGroupLimit" in _plan(df)
