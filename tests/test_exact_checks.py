"""Isolated suites, counted samples, exact sums and key calendars against small brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import groups, profile, reconcile
from plumbline.plans import guard, suite
from plumbline.plans.suite import CheckSpec

AS_OF = "2024-01-31 09:00:00"


def by_id(df):
    return {r["check_id"]: r for r in df.collect()}


def test_a_bad_check_is_data_in_the_scan_of_its_table(spark, monkeypatch):
    jobs = []
    collect = guard.collect_guarded

    def counted(frame, **how):
        jobs.append(how["limit"])
        return collect(frame, **how)

    monkeypatch.setattr(guard, "collect_guarded", counted)
    table = spark.createDataFrame([("2024-01-30 09:00:00", "5", 1), ("soon", "x", 2), (None, None, None)], "at string, v string, n int")
    specs = [
        CheckSpec("text_time", "t", "freshness", ("at",)), CheckSpec("text_range", "t", "range", ("v",), {"low": 0}),
        CheckSpec("good", "t", "nulls", ("n",)), CheckSpec("kinds", "t", "accepted", ("n",), {"allowed": ["1", "one"]}),
        CheckSpec("no_time", "t", "freshness", ("n",)), CheckSpec("gone", "t", "nulls", ("gone",)),
        CheckSpec("evil", "t", "sql", sql="DROP TABLE t"), CheckSpec("no_option", "t", "completeness", ("v", "at")),
    ]
    found = by_id(suite.run_suite(spark, {"t": table}, specs, AS_OF))
    assert {k: r["status"] for k, r in found.items()} == {
        "text_time": "failed", "text_range": "failed", "good": "ok", "kinds": "ok", "no_time": "skipped", "gone": "skipped",
        "evil": "rejected", "no_option": "skipped"}
    assert found["text_time"]["error"] == "1 values of at are no timestamp" and found["text_range"]["error"] == "1 values of v are no number"
    assert found["good"]["observed"] == 1.0 and found["kinds"]["observed"] == 1.0
    assert jobs == [4]


def test_readable_texts_are_measured(spark):
    table = spark.createDataFrame([("2024-01-30 09:00:00", "5"), ("2024-01-29", "-1.5")], "at string, v string")
    specs = [CheckSpec("fresh", "t", "freshness", ("at",)), CheckSpec("low", "t", "range", ("v",), {"low": 0})]
    found = by_id(suite.run_suite(spark, {"t": table}, specs, AS_OF))
    assert (found["fresh"]["observed"], found["low"]["observed"]) == (24 * 60.0, 1.0)
    bounds = profile.timestamp_bounds(table, "t", ["at"]).first()
    assert (bounds["min_ts"], bounds["max_ts"]) == (dt.datetime(2024, 1, 29), dt.datetime(2024, 1, 30, 9))
    unread = spark.createDataFrame([("never",)], "at string")
    assert profile.timestamp_bounds(unread, "t", ["at"]).first()["max_ts"] is None
    assert profile.freshness(unread, "t", "at", AS_OF).first()["severity"] == "fail"


def test_a_failing_column_leaves_the_others_in_halves(spark):
    table = spark.createDataFrame([("1",), ("x",)], "v string").select("v", F.col("v").cast("int").alias("n"))
    specs = [CheckSpec(f"good{i}", "t", "nulls", ("v",)) for i in range(7)] + [CheckSpec("bad", "t", "nulls", ("n",))]
    found = by_id(suite.run_suite(spark, {"t": table}, specs, AS_OF))
    assert {k for k, r in found.items() if r["status"] == "failed"} == {"bad"}
    assert all(found[f"good{i}"]["observed"] == 0.0 for i in range(7))


def test_records_carry_time_sql_and_named_cells(spark):
    table = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    specs = [CheckSpec("grain", "t", "duplicate_grain", ("k",), sql="SELECT k"), CheckSpec("seven", "t", "sql", sql="SELECT 7 AS seven")]
    log = suite.execution_records(
        suite.run_suite(spark, {"t": table}, specs, AS_OF), suite.spec_frame(spark, specs), "run", AS_OF
    )
    found = {r["query_id"]: r for r in log.collect()}
    assert found["grain"]["result_sample"] == [{"k": "1", "n": "2"}] and found["seven"]["result_sample"] == [{"seven": "7"}]
    assert found["grain"]["sql"] == "SELECT k" and found["seven"]["sql"].startswith("SELECT 7 AS seven")
    assert all(r["runtime_ms"] >= 0 for r in found.values())


def test_kinds_over_two_tables_and_schemas(spark):
    table = spark.createDataFrame([(1, 2.0, "2024-01-01"), (1, 3.0, "2024-01-02"), (2, 1.0, "2024-01-02")], "k int, v double, d string")
    table = table.withColumn("ts", F.col("d").cast("timestamp_ntz"))
    gold = spark.createDataFrame([(1, 5.0), (3, 1.0)], "k int, total double")
    specs = [
        CheckSpec("schema", "t", "schema", (), {"expected": {"k": "int", "v": "float", "d": "string", "ts": "timestamp_ntz", "x": "int"}}),
        CheckSpec("agg", "t", "aggregate", ("k", "v"), {"other": "g", "published": {"total": "total"}}),
        CheckSpec("keys", "t", "reconcile_keys", ("k",), {"other": "g", "other_columns": ("k",)}),
        CheckSpec("days", "t", "reconcile_days", ("ts",), {"other": "t", "other_columns": ("ts",)}),
        CheckSpec("nobody", "t", "reconcile_keys", ("k",), {"other": "gone", "other_columns": ("k",)}),
        CheckSpec("cover", "t", "coverage", ("k", "ts")), CheckSpec("cut", "t", "cutoff", ("ts",)),
        CheckSpec("full", "t", "completeness", ("k", "ts"), {"minimum": 1, "first_day": "2024-01-01", "last_day": "2024-01-02"}),
    ]
    found = by_id(suite.run_suite(spark, {"t": table, "g": gold}, specs, AS_OF))
    assert {k: r["observed"] for k, r in found.items()} == {
        "schema": 2.0, "agg": 2.0, "keys": 2.0, "days": 0.0, "nobody": None, "cover": 0.0, "cut": 1.0, "full": 1.0}
    assert found["nobody"]["status"] == "skipped"
    assert [c["column"] for c in found["schema"]["cells"]] == ["v", "x"]


@pytest.mark.parametrize("rows", [0, 3, 99, 100, 5000])
def test_the_true_count_beside_a_bounded_sample(spark, rows):
    result = guard.run_query(spark.range(rows).repartition(3))
    assert (result.status, result.total_rows, result.row_count, result.truncated) == ("ok", rows, min(rows, 99), rows > 99)
    found = guard.counted_sample(spark.range(rows), [F.col("id").desc()], 4).collect()
    assert [tuple(r) for r in found] == [(i, rows, rows > 4) for i in list(range(rows))[::-1][:4]]
    one = guard.first_and_count(spark.range(rows), 5).first()
    assert (one["total"], [f["row"]["id"] for f in one["found"]]) == (rows, list(range(rows))[:5])


def test_key_calendars_against_a_grid(spark):
    rng = random.Random(4)
    first = dt.date(2024, 1, 1)
    rows = [(rng.choice(["a", "b", "c", None]), first + dt.timedelta(days=rng.randrange(-5, 140))) for _ in range(900)] + [("far", dt.date(2020, 1, 1))]
    table = spark.createDataFrame(rows, "k string, d date").withColumn("ts", F.col("d").cast("timestamp_ntz")).withColumn("key", F.lit("clash"))
    for days, minimum in ((1, 1), (63, 2), (64, 1), (130, 3)):
        last = first + dt.timedelta(days=days - 1)
        grid = {}
        for key in {k for k, _ in rows}:
            missing = [d for d in (first + dt.timedelta(days=i) for i in range(days)) if sum(r == (key, d) for r in rows) < minimum]
            if missing:
                grid[key] = (days, len(missing), missing[0], missing[-1])
        found = groups.completeness_by_key(table, "k", "ts", minimum, str(first), str(last))
        assert {r["key"]: tuple(r)[1:] for r in found.collect()} == grid
    asked = spark.createDataFrame([("a",), ("never",), ("never",)], "k string")
    found = groups.completeness_by_key(table, "k", "ts", 1, "2024-01-01", "2024-01-02", keys=asked)
    assert {r["key"]: r["missing_days"] for r in found.collect()}["never"] == 2 and "far" not in {r["key"] for r in found.collect()}
    assert groups.completeness_by_key(table.limit(0), "k", "ts", 1, "2024-01-01", "2024-01-02").count() == 0


def test_sums_do_not_depend_on_order_and_duplicates_show(spark):
    values = [1e12, 0.1, -1e12, 0.2, 3e11, 0.7] * 50
    published = spark.createDataFrame([("a", 15e12 + 50.0), ("b", 10.0), ("b", 3.0), ("c", 1.0), ("e", None)], "k string, total double")
    totals = set()
    for seed in range(3):
        random.Random(seed).shuffle(values)
        rows = [("a", v) for v in values] + [("b", 4.0), ("b", 6.0), ("d", 1.0), ("e", float("nan"))]
        detail = spark.createDataFrame(rows, "k string, v double").repartition(seed + 1)
        found = reconcile.aggregate_sanity(detail, published, ["k"], "v", {"total": "total"}, only_problems=False)
        got = {r["k"]: r for r in found.collect()}
        assert {k: r["status"] for k, r in got.items()} == {
            "a": "match", "b": "duplicate_published", "c": "only_published", "d": "only_detail", "e": "match"}
        totals.add(got["a"]["derived_total"])
    assert len(totals) == 1
