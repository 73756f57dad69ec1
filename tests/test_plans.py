"""What the plans of the queries must and must not contain."""

import pytest

from plumbline import workload
from plumbline.operators import groups, runs

SMALL = "/root/testdata/sf0.001"
# These run models or numpy in Arrow batches; everything else is native.
WITH_PYTHON = {"embed_text", "vector_topk", "vector_topk_all", "vector_topk_approx", "vector_index_whole"}
BATCH = sorted(n for n in workload.load_all() if not n.startswith("stream_"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def without_auto_broadcast(spark):
    """Plans as they are for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_joins_and_no_stray_python(spark, without_auto_broadcast, name):
    plan = plan_of(workload.load_all()[name].run(spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "InArrow" in plan or "InPandas" in plan) == (name in WITH_PYTHON)


@pytest.mark.parametrize("name", ["reconcile_by_day", "reconcile_keys", "agg_sanity", "severity_rollup", "upsert_merge"])
def test_reduced_before_a_single_shuffle(spark, without_auto_broadcast, name):
    plan = plan_of(workload.load_all()[name].run(spark, SMALL))
    assert "Join" not in plan and "partial_" in plan
    # The published side of agg_sanity is an aggregate of its own.
    assert plan.count("Exchange ") == (2 if name == "agg_sanity" else 1)


def test_only_bounded_frames_are_broadcast(spark, without_auto_broadcast):
    for name in BATCH:
        if name in ("run_list", "vector_topk_approx", "vector_index_whole"):
            continue
        assert "BroadcastExchange" not in plan_of(workload.load_all()[name].run(spark, SMALL)), name
    listed = plan_of(workload.load_all()["run_list"].run(spark, SMALL))
    assert listed.count("TakeOrderedAndProject(limit=50") == 2


def test_day_ranges_and_columns_reach_the_scan(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    plan = plan_of(groups.group_completeness(events, "user_id", "ts", 2, "2024-01-05", "2024-01-06"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan
    plan = plan_of(groups.rows_by_day(events, "ts", since="2024-01-05"))
    assert "GreaterThanOrEqual(ts" in plan and "TakeOrderedAndProject(limit=14" in plan
    plan = plan_of(runs.where_equal(events, event_type="view").select("event_id"))
    assert "EqualTo(event_type,view)" in plan or "EqualNullSafe(event_type,view)" in plan
