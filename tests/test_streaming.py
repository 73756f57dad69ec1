"""Feeds: the same rows in one file or several give the same result."""

import datetime as dt

import pytest
from plumbline.operators import runs
from plumbline.session import shared_folder
from plumbline.streaming import feeds
from plumbline.streaming.runner import drain, open_stream
from plumbline.workload import streams


def landed(spark, frames, label):
    """One file per frame, in order of their names."""
    folder = shared_folder(spark, label)
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{folder}/part{i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def cut(rows, parts):
    size = -(-len(rows) // parts)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


NOTES = [
    ("question", "a", 1, "q1", 2), ("answer", "a", 1, "q1", None), ("answer", "a", 1, "q1", None),
    ("question", "b", 1, "q3", 1), ("answer", "a", 1, "unknown", None), ("question", "a", 1, "q2", 2),
    ("answer", "c", 1, "q9", None), ("answer", "a", 1, "q2", None), ("question", "a", 1, "q2", 2),
    ("answer", "a", 1, "q2", None), ("question", "a", 2, "q4", 1),
]


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("backwards", [False, True])
def test_gate_opens_once_whatever_the_batches(spark, parts, backwards):
    notes = NOTES[::-1] if backwards else NOTES
    schema = "kind string, run_id string, round int, question_id string, n_questions bigint"
    stream = landed(spark, [spark.createDataFrame(p, schema) for p in cut(notes, parts)], "notes")
    found = feeds.drain_gate(stream).collect()
    assert [(r["run_id"], r["round"], r["answered"]) for r in found] == [("a", 1, 2)]


CHANGES = [("r", i, s, n) for i, (s, n) in enumerate(
    [("pending", "a"), ("running", "a"), ("running", "a"), ("running", "b"), ("running", "b"), ("done", None)])]
CHANGES += [("s", 1, "pending", "a"), ("s", 9, "pending", "a")]


@pytest.mark.parametrize("parts, compact_every", [(1, 20), (3, 1), (8, 2), (8, 20)])
def test_status_changes_do_not_depend_on_batches(spark, parts, compact_every):
    schema = "run_id string, seq int, status string, current_node string"
    batch = spark.createDataFrame(CHANGES, schema)
    want = {(r["run_id"], r["seq"]) for r in runs.status_changes(batch, ["seq"]).collect()}
    stream = landed(spark, [spark.createDataFrame(p, schema) for p in cut(CHANGES, parts)], "status")
    found = feeds.drain_status_changes(stream, ["seq"], compact_every=compact_every).collect()
    assert {(r["run_id"], r["seq"]) for r in found} == want and len(found) == len(want)


def test_pending_runs_show_once(spark):
    rows = [("insert", "pending", None, "1"), ("update", "pending", None, "1"), ("insert", "pending", "webapp", "2"),
            ("delete", "pending", None, "3"), ("replace", "running", None, "4"), ("replace", "pending", "cli", "5"),
            ("insert", "pending", None, None)]
    schema = "operation string, status string, run_source string, run_id string"
    stream = landed(spark, [spark.createDataFrame(p, schema) for p in cut(rows, 3)], "pending")
    assert sorted(r["run_id"] for r in drain(feeds.pending_runs(stream), "pending").collect()) == ["1", "5"]


def test_answers_show_once_and_only_inserts(spark):
    rows = [("insert", "r", "q1"), ("update", "r", "q2"), ("insert", "r", "q1"), ("insert", "r", "q3"), ("insert", None, "q4")]
    stream = landed(spark, [spark.createDataFrame(p, "operation string, run_id string, question_id string")
                            for p in cut(rows, 2)], "answers")
    assert sorted(r["question_id"] for r in drain(feeds.new_answers(stream), "answers").collect()) == ["q1", "q3"]


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_by_day_counts_late_rows(spark, parts):
    rows = [(dt.datetime(2024, 1, d, 5),) for d in (3, 3, 1, 2, 3, 1)]
    stream = landed(spark, [spark.createDataFrame(p, "ts timestamp_ntz") for p in cut(rows, parts)], "days")
    found = feeds.current(drain(feeds.rows_by_day(stream, "ts"), "days", "update"), ["day"]).orderBy("day").collect()
    assert [(r["day"].day, r["n"]) for r in found] == [(1, 2), (2, 1), (3, 3)]


def test_watermark_lets_days_go(spark):
    rows = [(dt.datetime(2024, 1, d, 5),) for d in (1, 9, 9, 1)]
    stream = landed(spark, [spark.createDataFrame([r], "ts timestamp_ntz") for r in rows], "late")
    kept = feeds.current(drain(feeds.rows_by_day(stream, "ts", late="1 hour"), "late", "update"), ["day"]).collect()
    assert sorted((r["day"].day, r["n"]) for r in kept) == [(1, 1), (9, 2)]


def test_drain_goes_on_from_its_checkpoint(spark):
    folder, source = shared_folder(spark, "resume"), shared_folder(spark, "resume-source")
    frame = spark.createDataFrame([("insert", "r", "q1")], "operation string, run_id string, question_id string")
    frame.write.mode("append").parquet(source)
    for extra in (["q1", "q2"], ["q2", "q3"]):
        stream = feeds.new_answers(spark.readStream.schema(frame.schema).parquet(source))
        found = drain(stream, "resume", folder=folder)
        spark.createDataFrame([("insert", "r", q) for q in extra], frame.schema).write.mode("append").parquet(source)
    found = drain(feeds.new_answers(spark.readStream.schema(frame.schema).parquet(source)), "resume", folder=folder)
    assert sorted(r["question_id"] for r in found.collect()) == ["q1", "q2", "q3"]


def test_a_stream_over_one_file(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    stream = open_stream(spark, path, spark.read.parquet(path).schema)
    assert drain(stream.select("o_orderkey"), "one-file").count() == spark.read.parquet(path).count()


def test_nothing_available_is_an_empty_table(spark):
    folder = shared_folder(spark, "empty")
    spark.createDataFrame([], "run_id string, question_id string, operation string").write.parquet(folder)
    stream = spark.readStream.schema("run_id string, question_id string, operation string").parquet(folder)
    assert drain(feeds.new_answers(stream), "empty").count() == 0


def test_the_gate_counts_the_questions_of_a_round_once(spark, sf_dir, monkeypatch):
    notes = []
    monkeypatch.setattr(streams.feeds, "drain_gate", lambda df: notes.append(df) or df)
    streams.stream_gate(spark, sf_dir)
    plan = notes[0]._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate") == 1 and plan.count("StreamingRelation") == 2
