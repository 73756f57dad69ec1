"""Suites, guardrails, rules, suggestions and reports."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from plumbline.plans import guard, report, rules, suggest, suite
from plumbline.plans.run import quality_run
from plumbline.plans.suite import CheckSpec
from plumbline.workload.suites import SPECS, suite_tables
from plumbline.workload.tables import AS_OF


def as_rows(df):
    return {r["check_id"]: r.asDict() for r in df.collect()}


def test_fused_equals_separate(spark, sf_dir):
    tables = suite_tables(spark, sf_dir)
    together = as_rows(suite.evidence(spark, tables, SPECS, AS_OF))
    for spec in SPECS:
        assert as_rows(suite.evidence(spark, tables, [spec], AS_OF))[spec.id] == together[spec.id]


def test_scalar_checks_share_a_scan_without_python(spark, sf_dir):
    scalar = [s for s in SPECS if s.target_table == "events" and s.kind in suite.SCALAR_KINDS]
    df = suite.evidence(spark, {"events": suite_tables(spark, sf_dir)["events"]}, scalar[:5], AS_OF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_missing_column_is_skipped_not_fatal(spark):
    tables = {"t": spark.createDataFrame([(1,)], "v int")}
    specs = [CheckSpec("a", "t", "nulls", ("gone",)), CheckSpec("b", "t", "row_count"), CheckSpec("c", "x", "row_count"),
             CheckSpec("d", "t", "magic")]
    found = as_rows(suite.evidence(spark, tables, specs, AS_OF))
    assert {k: v["status"] for k, v in found.items()} == {"a": "skipped", "b": "ok", "c": "skipped", "d": "skipped"}
    assert "gone" in found["a"]["error"]


def test_empty_suite(spark):
    assert suite.evidence(spark, {}, [], AS_OF).count() == 0


def test_empty_table_gives_a_record_per_check(spark):
    tables = {"t": spark.createDataFrame([], "ts timestamp_ntz, v double, k string")}
    specs = [CheckSpec("fresh", "t", "freshness", ("ts",)), CheckSpec("days", "t", "rows_by_day", ("ts",)),
             CheckSpec("nulls", "t", "nulls", ("v",)), CheckSpec("grain", "t", "duplicate_grain", ("k",))]
    found = suite.evidence(spark, tables, specs, AS_OF)
    severities = {r["related_check"]: r["severity"] for r in rules.findings(found, rules.bands(spark)).collect()}
    assert severities == {"fresh": "fail", "days": "warn", "nulls": "pass", "grain": "pass"}


def test_failing_check_does_not_stop_the_others(spark):
    bad = spark.createDataFrame([("1",), ("x",)], "v string").select("v", F.col("v").cast("int").alias("n"))
    specs = [CheckSpec("bad", "t", "nulls", ("n",)), CheckSpec("good", "t", "nulls", ("v",)),
             CheckSpec("sql", "t", "sql", sql="SELECT 7 AS seven"), CheckSpec("evil", "t", "sql", sql="DROP TABLE t"),
             CheckSpec("typo", "t", "sql", sql="SELECT nothing FROM nowhere")]
    found = as_rows(suite.run_suite(spark, {"t": bad}, specs, AS_OF))
    assert {k: v["status"] for k, v in found.items()} == {
        "bad": "failed", "good": "ok", "sql": "ok", "evil": "rejected", "typo": "failed"}
    assert found["good"]["observed"] == 0.0 and "CAST_INVALID_INPUT" in found["bad"]["error"]
    log = suite.execution_records(
        suite.run_suite(spark, {"t": bad}, specs[1:2], AS_OF), suite.spec_frame(spark, specs), "run", "2024-01-01 00:00:00"
    ).first()
    assert (log["run_id"], log["query_id"], log["status"], log["row_count"]) == ("run", "good", "ok", 1)


def test_timeout_cancels_the_job(spark):
    slow = spark.range(10**13).agg(F.sum(F.col("id") % 7).alias("x"))
    outcome = guard.run_query(slow, timeout_seconds=1)
    assert outcome.status == "timeout"
    # The job is gone, not just given up on: its tasks leave the cores.
    tracker = spark.sparkContext.statusTracker()
    deadline = time.monotonic() + 30
    while tracker.getActiveStageIds() and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not tracker.getActiveStageIds()


def test_sample_is_bounded_and_text(spark):
    result = guard.run_sql(spark, "SELECT id, IF(id = 0, NULL, id) AS n FROM range(500)")
    assert (result.status, result.row_count, len(result.sample)) == ("ok", 99, 25)
    assert result.sample[0] == {"id": "0", "n": None} and result.sql.endswith("LIMIT 1000")


def test_columns_of_one_name_collapse_to_the_last(spark):
    assert guard.run_sql(spark, "SELECT 1 AS a, 2 AS a").sample == [{"a": "2"}]


def test_byte_cap(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert guard.scan_bytes(events) > 1000
    assert guard.run_query(events, max_bytes=10).exceeded_byte_cap
    assert guard.run_query(events, max_bytes=10, enforce_bytes=True).status == "rejected"


@pytest.mark.parametrize("observed, severity", [(0.05, "pass"), (0.0501, "warn"), (0.2, "warn"), (0.21, "fail")])
def test_bands(spark, observed, severity):
    row = ("c", "n", "row_count", "t", "rows_by_day", "ok", observed, 14, None, None)
    found = rules.findings(spark.createDataFrame([row], suite.EVIDENCE), rules.bands(spark)).first()
    assert found["severity"] == severity


def test_suggestions_run_and_name_only_real_columns(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders")}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    found = suggest.suggest_checks(suggest.column_profile(tables)).collect()
    for r in found:
        assert r["column"] in tables[r["table_id"]].columns
        assert guard.run_sql(spark, r["sql"]).status == "ok", r["sql"]


def test_suggestions_for_an_empty_table(spark):
    profile = suggest.column_profile({"t": spark.createDataFrame([], "ts timestamp, k string, v double")})
    assert {r["kind"] for r in suggest.suggest_checks(profile).collect()} == {"freshness", "rows_by_day"}


def test_time_columns_and_ranges_by_type(spark):
    table = spark.createDataFrame(
        [(i, "2024-01-0%d 10:00:00" % (1 + i % 9), "day %d" % i, dt.date(2024, 1, 1 + i), i % 3) for i in range(20)],
        "k int, said string, note string, day date, n int",
    ).withColumn("amount", F.expr("cast(n as decimal(12, 2))")).withColumn("debt", F.expr("cast(n - 2 as decimal(12, 2))"))

    def kinds(df):
        return {(r["kind"], r["column"]) for r in suggest.suggest_checks(suggest.column_profile({"t": df})).collect()}

    found = kinds(table)
    assert ("freshness", "day") in found and ("freshness", "said") not in found
    assert {c for k, c in found if k == "range"} == {"n", "amount"}
    found = kinds(table.drop("day"))
    assert ("freshness", "said") in found and ("freshness", "note") not in found
    table = table.drop("day")
    result = quality_run(spark, {"t": table}, run_id="r", as_of="2024-01-31 09:00:00")
    assert {r["status"] for r in result.executions.collect()} == {"ok"}


def test_every_table_of_a_run_gets_checks(spark):
    tables = {f"t{i}": spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string") for i in range(12)}
    result = quality_run(spark, tables, run_id="r", as_of=AS_OF)
    assert {s.target_table for s in result.specs} == set(tables) and len(result.specs) >= 24


def test_report_reads_in_order(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    found = spark.createDataFrame(
        [("r", "B", "pass", "e", "no action", at), ("r", "A", "fail", "e", "fix", at), ("r", "C", None, None, "fix", at)],
        "run_id string, title string, severity string, evidence string, recommended_action string, created_at timestamp_ntz",
    )
    known = spark.createDataFrame([("r", "t1", "one", False), ("r", "t2", None, True)],
                                  "run_id string, table_id string, business_description string, parsing_failed boolean")
    lines = report.report_lines(found, known)
    report.write_report(lines, "r", str(tmp_path / "report"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert text == [
        "# Data QA Report", "Reviewed 1 tables. Severity summary: 1 pass, 0 warn, 1 fail.", "- **t1** — one",
        "- not characterised: t2", "- [FAIL] A — e", "- [PASS] B — e", "- [NONE] C — ", "- fix"]
    assert report.report_summaries(found).first()["severity_summary"].asDict() == {"pass": 1, "warn": 0, "fail": 1}


def test_a_whole_run_is_kept(spark, sf_dir, tmp_path):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders")}
    store = str(tmp_path / "store")
    for run_id in ("r1", "r2"):
        result = quality_run(spark, tables, run_id=run_id, as_of=AS_OF, store=store)
    assert len(result.specs) == suggest.TARGET_CHECKS
    kept = spark.read.parquet(f"{store}/executions")
    assert kept.groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 8), ("r2", 8)]
    assert {r["status"] for r in kept.collect()} == {"ok"}
    rollups = spark.read.parquet(f"{store}/reports").orderBy("run_id").collect()
    found = spark.read.parquet(f"{store}/findings")
    assert sum(rollups[0][s] for s in ("pass", "warn", "fail")) == found.where("run_id = 'r1'").count()
    assert spark.read.parquet(f"{store}/report_lines").where("run_id = 'r2' AND section = 1").count() == 1


def test_a_timeout_starts_no_further_jobs(spark, monkeypatch):
    from plumbline.plans import guard, suite

    calls = []

    def stopped(frame, *, limit, timeout_seconds):
        calls.append(limit)
        return guard.Outcome("timeout", error="stopped")

    monkeypatch.setattr(guard, "collect_guarded", stopped)
    table = spark.createDataFrame([(1, 2)], "a int, b int")
    specs = [suite.CheckSpec(c, "t.x", "nulls", (c,)) for c in ("a", "b")]
    got = suite.run_suite(spark, {"t.x": table}, specs, "2024-01-31 09:00:00", timeout_seconds=1).collect()
    assert len(calls) == 1 and [r.status for r in got] == ["timeout", "timeout"]
