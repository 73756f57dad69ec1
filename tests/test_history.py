"""Run history, versions, logs and skew-safe ordering on small frames."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.ordering import chunked_text, lay_out, split_position, split_previous
from plumbline.operators import runs, versions
from plumbline.session import shared_folder
from plumbline.sources import catalog, logs

LOG = "k string, seq bigint, a string, b string, present array<string>"
MANY = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_upsert_keeps_what_was_not_set(spark):
    log = spark.createDataFrame([
        ("x", 1, "a1", "b1", ["a", "b"]), ("x", 2, "a2", None, ["a"]), ("x", 3, None, None, ["b"]),
        ("y", 1, "a9", None, ["a"]),
    ], LOG)
    found = {r["k"]: (r["a"], r["b"], r["updated_at"]) for r in logs.upsert_merge(log, ["k"], ["a", "b"], ["seq"]).collect()}
    assert found == {"x": ("a2", None, 3), "y": ("a9", None, 1)}


def test_delete_by_key(spark):
    log = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    gone = spark.createDataFrame([("x",)], "k string")
    assert [r["k"] for r in logs.delete_by_key(log, gone, ["k"]).collect()] == ["y"]


def test_overwrite_leaves_other_partitions(spark):
    folder = shared_folder(spark, "test")
    logs.overwrite_partitions(spark.createDataFrame([(1, "d1"), (2, "d2")], "v int, d string"), folder, ["d"])
    for _ in range(2):
        logs.overwrite_partitions(spark.createDataFrame([(3, "d2")], "v int, d string"), folder, ["d"])
    assert sorted(tuple(r) for r in logs.read_log(spark, folder).collect()) == [(1, "d1"), (3, "d2")]


def test_append_log_accumulates(spark):
    folder = shared_folder(spark, "test")
    for i in range(2):
        logs.append_log(spark.createDataFrame([("r", i)], "run_id string, v int"), folder)
    assert logs.read_log(spark, folder).count() == 2


def test_versions_count_failed_parses(spark):
    rows = spark.createDataFrame([("t", 1, False), ("t", 2, True), ("t", 3, False), ("u", 1, False)],
                                 "table_id string, at int, parsing_failed boolean")
    stored = spark.createDataFrame([("u", 4)], "table_id string, version bigint")
    numbered = versions.assign_versions(rows, stored, ["at"])
    assert sorted((r["table_id"], r["version"]) for r in numbered.collect()) == [("t", 1), ("t", 2), ("t", 3), ("u", 5)]
    newest = versions.latest_version(runs.usable(numbered))
    assert sorted((r["table_id"], r["version"]) for r in newest.collect()) == [("t", 3), ("u", 5)]


@MANY
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), min_size=1, max_size=40, unique=True),
       st.integers(1, 9))
def test_split_position_is_a_row_number(spark, rows, slices):
    df = spark.createDataFrame(rows, "k string, at int")
    placed = split_position(df, ["k"], ["at"], slices=slices)
    want = {(k, at): 1 + sum(1 for k2, at2 in rows if k2 == k and at2 < at) for k, at in rows}
    assert {(r["k"], r["at"]): r["position"] for r in placed.collect()} == want


@MANY
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["x", "y", None])), min_size=1, max_size=30,
                unique_by=lambda r: r[0]), st.integers(1, 9))
def test_split_previous_is_a_lag(spark, rows, slices):
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, at int, v string")
    seen = split_previous(df, ["k"], ["at"], F.col("v"), slices=slices)
    ordered = sorted(rows)
    want = {at: (ordered[i - 1][1] if i else None) for i, (at, _) in enumerate(ordered)}
    assert {r["at"]: r["previous"] for r in seen.collect()} == want


def test_a_hot_key_is_cut_into_even_slices(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.lit(1).alias("day"), "id")
    laid = lay_out(rows, ["k"], ["day", "id"], slices=10)
    sizes = [r["count"] for r in laid.groupBy("_slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 9000 / 10


def test_chunks_lose_nothing(spark):
    df = spark.createDataFrame([("k", i, f"t{i}") for i in range(25)], "k string, at int, t string")
    found = chunked_text(df, ["k"], "t", ["at"], chunk_size=10, slices=7).orderBy("chunk")
    joined = [r["texts"] for r in found.collect()]
    assert len(joined) == 3 and "; ".join(joined) == "; ".join(f"t{i}" for i in range(25))


def test_findings_match_by_id_before_name(spark):
    checks = spark.createDataFrame([("r", "c1", "fresh", "ok"), ("r", "c2", "rows", "ok"), ("r", "c3", "c1", "ok")],
                                   "run_id string, query_id string, check_name string, status string")
    found = spark.createDataFrame([("r", "c1", "A", 1), ("r", "c1", "B", 2), ("r", "rows", "C", 3), ("r", None, "D", 4)],
                                  "run_id string, related_check string, title string, at int")
    rows = runs.findings_by_check(checks, found, ["at"]).collect()
    assert {r["query_id"]: (r["matched_by"], r["supports"]) for r in rows} == {
        "c1": ("id", "A; B"), "c2": ("name", "C"), "c3": (None, None)}


def test_severity_counts_only_exact_words(spark):
    found = spark.createDataFrame([("r", s) for s in ("pass", "warn", "fail", "PASS", None)], "run_id string, severity string")
    assert tuple(runs.severity_rollup(found).first()) == ("r", 1, 1, 1)


@pytest.mark.parametrize("limit, size", [(0, 1), (-3, 1), (20, 20), (1000, 50)])
def test_run_list_clamps_and_puts_missing_last(spark, limit, size):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i < 10 else start + dt.timedelta(hours=i), start) for i in range(60)]
    listed = runs.run_list(
        spark.createDataFrame(rows, "run_id int, started_at timestamp, updated_at timestamp"),
        spark.createDataFrame([(59, 1, 2, 3)], "run_id int, pass bigint, warn bigint, fail bigint"), limit,
    ).collect()
    assert len(listed) == size
    assert {r["run_id"] for r in listed} == set(range(60 - size, 60))
    assert {(r["pass"], r["warn"], r["fail"]) for r in listed if r["run_id"] != 59} <= {(0, 0, 0)}


QUESTIONS = "run_id string, round int, question_id string, n_questions bigint, table_id string, question string, asked_at int"


def test_gate(spark):
    asked = spark.createDataFrame([
        ("done", 1, "q1", 2, "t", "?", 1), ("done", 1, "q2", 2, "t", "?", 2), ("done", 1, "q2", 2, "t", "?", 2),
        ("partial", 1, "q3", 2, "t", "?", 1), ("partial", 1, "q4", 2, "t", "?", 1), ("later", 2, "q5", 1, "t", "?", 1),
    ], QUESTIONS)
    given_ = spark.createDataFrame([
        ("done", 1, "q1", "a"), ("done", 1, "q2", "b"), ("partial", 1, "q3", "c"), ("partial", 1, "unknown", "d"),
        ("nobody", 1, "q9", "e"),
    ], "run_id string, round int, question_id string, answer string")
    for salt_above in (100_000, 1):
        found = runs.answers_complete(asked, given_, salt_above=salt_above).orderBy("asked_at").collect()
        assert [(r["run_id"], r["question_id"], r["answer"]) for r in found] == [("done", "q1", "a"), ("done", "q2", "b")]


def test_question_ids_repeat(spark):
    rows = spark.createDataFrame([("r", 1, "t", "why?"), ("r", 1, "t", "why?"), ("r", 2, "t", "why?"), ("r", 1, None, "twhy?")],
                                 "run_id string, round int, table_id string, question string")
    ids = [r["question_id"] for r in runs.with_question_id(rows).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_answer_batches_are_judged_before_storing(spark):
    pending = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "4")], "run_id string, question_id string")
    provided = spark.createDataFrame([("a", "1", "x"), ("b", "3", "  "), ("c", "4", " ok "), ("c", "zz", "")],
                                     "run_id string, question_id string, answer string")
    found = {r["run_id"]: r["verdict"] for r in runs.validate_answers(pending, provided).collect()}
    assert found == {"a": "missing_answers", "b": "blank_answer", "c": "accepted"}


def test_routing_skips_other_owners_and_missing_ids(spark):
    rows = spark.createDataFrame([("1", "webapp"), ("2", None), ("3", "cli"), (None, "cli"), ("", "cli")],
                                 "run_id string, run_source string")
    assert [r["run_id"] for r in runs.for_daemon(rows).orderBy("run_id").collect()] == ["2", "3"]


def test_snapshot_of_one_run(spark):
    frame = spark.createDataFrame
    parts = runs.run_snapshot(
        "r", runs=frame([("r",), ("s",)], "run_id string"),
        questions=frame([("r", "q1", 2), ("r", "q2", 1), ("s", "q3", 1)], "run_id string, question_id string, created_at int"),
        answers=frame([("r", "q1", 5)], "run_id string, question_id string, answered_at int"),
        executions=frame([("r", 2), ("r", 1), ("s", 1)], "run_id string, executed_at int"),
        findings=frame([("r", "fail", 1)], "run_id string, severity string, created_at int"),
        reports=frame([("r", "# x", 9)], "run_id string, markdown string, generated_at int"),
    )
    assert [r["question_id"] for r in parts["pending_questions"].collect()] == ["q2"]
    assert [r["executed_at"] for r in parts["executed_queries"].collect()] == [1, 2]
    assert parts["documents"].first()["generated_at"] == 9
    assert parts["summary"].first().asDict() == {
        "run_id": "r", "pending_questions": 1, "answered_questions": 1, "executed_queries": 2, "findings": 1,
        "pass": 0, "warn": 0, "fail": 1}


def test_status_changes_need_no_key(spark):
    rows = spark.createDataFrame([("r", 1, None, None), ("r", 2, None, None), ("r", 3, "running", "x"), ("r", 4, "running", "x")],
                                 "run_id string, seq int, status string, current_node string")
    found = runs.status_changes(rows, ["seq"]).orderBy("seq").collect()
    assert [(r["seq"], r["status_key"]) for r in found] == [(1, "unknown:none"), (3, "running:x")]


def test_ids(spark):
    ids = spark.createDataFrame([("t",), ("d.t",), ("c.d.t",), ("a.b.c.d",)], "table_id string")
    found = {r["table_id"]: (r["catalog"], r["database"], r["name"], r["legacy_db"], r["legacy_name"])
             for r in catalog.resolve_ids(ids).collect()}
    assert found["t"] == (None, "default", "t", "default", "t")
    assert found["d.t"] == (None, "d", "t", "d", "t")
    assert found["c.d.t"] == ("c", "d", "t", "c", "d.t")
    assert found["a.b.c.d"] == ("a", "b", "c.d", "a", "b.c.d")


def test_catalog_errors_are_rows(spark):
    row = catalog.table_columns(spark, "nowhere.nothing").first()
    assert row["database"] == "nowhere" and row["name"] == "nothing" and "nothing" in row["error"]
    assert catalog.table_columns(spark, "bad id; drop").first()["error"]


def test_catalog_lists_partitions(spark):
    spark.createDataFrame([(1, "d")], "v int, d string").write.mode("overwrite").partitionBy("d").saveAsTable("listed")
    rows = catalog.table_columns(spark, "listed").orderBy("ordinal").collect()
    assert [(r["column"], r["type"], r["is_partition"]) for r in rows] == [("v", "int", False), ("d", "string", True)]
    assert rows[0]["location"] and rows[0]["error"] is None


def test_schema_diff(spark):
    schema = "table_id string, column string, type string, is_partition boolean"
    want = spark.createDataFrame([("t", "a", "int", False), ("t", "b", "int", False), ("t", "c", "int", True), ("t", "d", "int", False)], schema)
    have = spark.createDataFrame([("t", "a", "int", False), ("t", "b", "bigint", False), ("t", "c", "int", False), ("t", "e", "int", False)], schema)
    assert {r["column"]: r["change"] for r in catalog.schema_diff(want, have).collect()} == {
        "a": "match", "b": "type_changed", "c": "partition_changed", "d": "missing", "e": "extra"}


def test_first_list_wins(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1), ("x", 2)], "table_id string, position int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "table_id string, position int")
    found = catalog.union_distinct(a, b).orderBy("list_no", "position").collect()
    assert [tuple(r) for r in found] == [("x", 0, 0), ("y", 0, 1), ("z", 1, 1)]
