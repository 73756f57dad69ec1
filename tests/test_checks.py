"""Profiles, group checks and reconciliation on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import groups, profile, reconcile
from plumbline.operators.profile import RangeRule


def days(spark, counts, start=dt.date(2024, 1, 1)):
    rows = [(start + dt.timedelta(i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "day date, n bigint")


def readings(spark, rows):
    return spark.createDataFrame(rows, "k string, ts string, v double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def test_empty_table(spark):
    empty = readings(spark, [])
    assert profile.row_count(empty, "t").first()["row_count"] == 0
    fresh = profile.freshness(empty, "t", "ts", "2024-01-02 00:00:00").first()
    assert fresh["latest"] is None and fresh["severity"] == "fail"
    nulls = profile.null_profile(empty, "t").collect()
    assert [(r["nulls"], r["null_share"]) for r in nulls] == [(0, None)] * 3
    ratio = groups.grain_ratio(empty, "t", ["k"]).first()
    assert (ratio["rows"], ratio["groups"], ratio["is_unique"]) == (0, 0, True)
    assert groups.rows_by_day(empty, "ts").count() == 0
    assert groups.duplicate_grain(empty, ["k"]).count() == 0


def test_all_null_column(spark):
    rows = readings(spark, [(None, None, None)] * 3)
    shares = {r["column"]: r["null_share"] for r in profile.null_profile(rows, "t").collect()}
    assert shares == {"k": 1.0, "ts": 1.0, "v": 1.0}
    bounds = profile.timestamp_bounds(rows, "t", ["ts"]).first()
    assert bounds["min_ts"] is None and bounds["max_ts"] is None


@pytest.mark.parametrize("as_of, severity", [
    ("2024-01-02 00:00:00", "pass"), ("2024-01-02 00:01:00", "warn"), ("2024-01-03 00:01:00", "fail"),
])
def test_freshness_bands(spark, as_of, severity):
    rows = readings(spark, [("a", "2024-01-01 00:00:00", 1.0)])
    assert profile.freshness(rows, "t", "ts", as_of).first()["severity"] == severity


def test_first_candidate_wins(spark):
    rows = readings(spark, [("a", "2024-01-01 00:00:00", 1.0)]).withColumn("later", F.col("ts"))
    assert profile.timestamp_bounds(rows, "t", ["nope", "later", "ts"]).first()["ts_column"] == "later"
    assert profile.timestamp_bounds(rows, "t", ["nope"]) is None


def test_fused_profile_equals_single_checks(spark):
    rows = readings(spark, [("a", "2024-01-01 00:00:00", -1.0), (None, "2024-01-03 00:00:00", 9.0)])
    rules = [RangeRule("r", "v", 0, 5)]
    fused = {(r["column"], r["metric"]): r["number"] if r["at"] is None else r["at"]
             for r in profile.table_profile(rows, "t", timestamps=["ts"], rules=rules).collect()}
    assert fused[(None, "rows")] == 2
    assert fused[("k", "nulls")] == 1
    assert fused[("v", "outside:r")] == profile.range_rules(rows, "t", rules).first()["violations"] == 2
    assert fused[("ts", "max")] == dt.datetime(2024, 1, 3)


def test_profile_is_one_scan_of_the_needed_columns(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = profile.table_profile(events, "t", timestamps=["ts"], columns=["value"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_nullable_expected(spark):
    rows = readings(spark, [(None, "2024-01-01 00:00:00", 1.0)])
    expected = spark.createDataFrame(
        [("t", "k", False), ("t", "v", False), ("t", "ts", True), ("t", "gone", False)],
        "table_id string, column string, nullable_expected boolean",
    )
    found = profile.nullable_expected(profile.null_profile(rows, "t"), expected)
    assert {r["column"]: r["severity"] for r in found.collect()} == {"k": "fail", "v": "pass", "gone": "skipped"}


def test_tied_counts_are_ordered(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    assert [r["value"] for r in groups.accepted_values(rows, "v", 2).collect()] == ["a", "b"]


def test_violations_from_list_and_frame_agree(spark):
    rows = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "v string")
    allowed = spark.createDataFrame([("a",)], "anything string")
    for known in (["a"], allowed):
        assert [tuple(r) for r in groups.accepted_violations(rows, "v", known).collect()] == [("x", 2)]


def test_even_length_median(spark):
    found = groups.median_deviation(days(spark, [10, 20])).first()
    assert found["median_n"] == 15.0


def test_zero_median_is_no_error(spark):
    found = groups.median_deviation(days(spark, [0] * 14)).collect()
    assert {(r["deviation"], r["severity"]) for r in found} == {(None, "warn")}


def test_deviation_bands(spark):
    found = groups.median_deviation(days(spark, [100, 100, 100, 105, 120, 121])).collect()
    by_day = {r["n"]: r["severity"] for r in found}
    assert by_day[100] == "pass" and by_day[121] == "warn"
    found = groups.median_deviation(days(spark, [100] * 5 + [105, 120, 121])).collect()
    assert {r["n"]: r["severity"] for r in found} == {100: "pass", 105: "pass", 120: "warn", 121: "fail"}


def test_partial_last_day(spark):
    counts = days(spark, [48] * 13 + [20])
    last = dt.date(2024, 1, 14)
    before = groups.cutoff_status(counts, "2024-01-15 08:59:59").where(F.col("day") == F.lit(last)).first()
    after = groups.cutoff_status(counts, "2024-01-15 09:00:00").where(F.col("day") == F.lit(last)).first()
    assert (before["severity"], after["severity"]) == ("warn", "fail")


def test_day_over_day(spark):
    found = groups.day_over_day(days(spark, [10, 5, 0, 4])).orderBy("day").collect()
    assert [(r["change"], r["change_share"]) for r in found] == [(None, None), (-5, -0.5), (-5, -1.0), (4, None)]


def test_vanished_key(spark):
    rows = readings(spark, [("a", "2024-01-01 01:00:00", 1.0), ("b", "2024-01-01 01:00:00", 1.0),
                            ("b", "2024-01-02 01:00:00", 1.0)])
    assert [tuple(r) for r in groups.coverage_drop(rows, "k", "ts").collect()] == [("a", dt.date(2024, 1, 1))]


def test_days_without_rows_are_listed(spark):
    rows = readings(spark, [
        ("a", "2024-01-02 10:00:00", 1.0), ("a", "2024-01-02 11:00:00", 1.0), ("a", "2024-01-05 10:00:00", 1.0),
        ("b", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-06 23:59:59", 1.0), ("a", "2024-01-09 10:00:00", 1.0),
    ])
    found = groups.group_completeness(rows, "k", "ts", 2, "2024-01-01", "2024-01-06").collect()
    got = sorted((r["key"], r["day"].day, r["n"]) for r in found)
    assert got == [("a", 1, 0), ("a", 3, 0), ("a", 4, 0), ("a", 5, 1), ("a", 6, 0),
                   ("b", 1, 1), ("b", 2, 0), ("b", 3, 0), ("b", 4, 0), ("b", 5, 0), ("b", 6, 1)]


def test_reconcile_by_day(spark):
    left = readings(spark, [("a", "2024-01-01 01:00:00", 1.0)] * 2)
    right = readings(spark, [("a", "2024-01-01 02:00:00", 1.0), ("a", "2024-01-03 02:00:00", 1.0)])
    found = reconcile.reconcile_by_day(left, "ts", right, "ts").orderBy("day").collect()
    assert [tuple(r)[1:] for r in found] == [(2, 1, -1), (0, 1, 1)]


def test_reconcile_keys_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([("hot",)] * 50 + [("left",), (None,)], "k string")
    right = spark.createDataFrame([("hot",), ("right",)], "k string")
    found = {tuple(r) for r in reconcile.reconcile_keys(left, ["k"], right, ["k"]).collect()}
    assert found == {("left", "target"), ("right", "source"), (None, "target")}


def test_aggregate_sanity_statuses(spark):
    detail = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 1.0)], "k string, v double")
    gold = spark.createDataFrame([("a", 3.0, 2.0), ("b", 5.5, 5.0), ("d", 1.0, 1.0)], "k string, total double, top double")
    found = reconcile.aggregate_sanity(detail, gold, ["k"], "v", {"total": "total", "peak": "top"}, only_problems=False)
    assert {r["k"]: r["status"] for r in found.collect()} == {
        "a": "match", "b": "differs", "c": "only_detail", "d": "only_published"}
