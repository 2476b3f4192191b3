"""Physical-plan properties of the registered queries."""

import pytest

from tests.conftest import SMALL

from fleetscope.plans import catalog

QUERIES = catalog.queries()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_time_filter_and_columns_reach_the_scan(spark):
    p = plan_of(QUERIES["A4_baseline_7d"](spark, SMALL))
    assert "GreaterThanOrEqual(ts," in p
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["A3_latest_value", "P1_metric_series_30m", "W4_sparkline_buckets", "H3_F17_threat_summary"])
def test_time_bound_reaches_the_scan(spark, name):
    assert "GreaterThanOrEqual(ts" in plan_of(QUERIES[name](spark, SMALL))


def test_attacker_users_are_the_rows_of_the_lists(spark):
    from fleetscope.operators import security
    from fleetscope.plans.catalog import AS_OF_TS
    from fleetscope.sources import bindings as B
    logs = B.logs(spark, SMALL)
    rows = {}
    for r in security.attacker_users(logs, AS_OF_TS).collect():
        rows.setdefault((r.server_id, r.ip), []).append(r.user)
    lists = security.attackers(logs, AS_OF_TS).collect()
    assert lists and all(sorted(rows.get((r.server_id, r.ip), [])) == list(r.users) for r in lists)
