"""Feeds of new work, new answers, complete rounds, status changes and counts per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import count_all, day
from ..functions.ordering import split_previous
from ..operators import runs
from ..session import shared_folder
from .runner import drain, read_drained, rows_path, write_drained

# The kinds of change that can make a run pending.
RUN_OPERATIONS = ("insert", "update", "replace")


def pending_runs(changes: DataFrame) -> DataFrame:
    """Runs to start: latest document pending, not owned elsewhere, each run once for ever.

    ``changes`` has operation, status, run_source and run_id.  The state holds
    every run id seen, as the feed's promise demands.
    """
    wanted = changes.where(F.col("operation").isin(*RUN_OPERATIONS) & (F.col("status") == "pending"))
    return runs.for_daemon(wanted).dropDuplicates(["run_id"])


def new_answers(changes: DataFrame) -> DataFrame:
    """Inserted answers, once per run and question; a re-answer is an update and does not show."""
    inserted = changes.where((F.col("operation") == "insert") & F.col("run_id").isNotNull())
    return inserted.dropDuplicates(["run_id", "question_id"])


def question_matches(notes: DataFrame) -> DataFrame:
    """Questions that are both asked and answered.  Output mode: update.

    ``notes`` are questions and answers under each other: kind ("question" or
    "answer"), run_id, round, question_id, n_questions (of the round, null on
    answers).  An answer with an unknown id never gets a question and stays
    silent.  State is one row per question, so a round with very many questions
    is spread out.  A repeated note shows its question again, which
    :func:`complete_rounds` ignores.
    """
    return (
        notes.groupBy("run_id", "round", "question_id")
        .agg(
            F.max(F.col("n_questions").cast("bigint")).alias("n_questions"),
            F.bool_or(F.col("kind") == "answer").alias("_answered"),
        )
        .where(F.col("_answered") & F.col("n_questions").isNotNull())
        .drop("_answered")
    )


def complete_rounds(matches: DataFrame) -> DataFrame:
    """Rounds whose questions are all answered, each emitted once.  Output mode: update.

    ``matches`` is a stream over the drained :func:`question_matches`.  Every
    question counts once, added up per round with partial sums.  The count only
    grows and stops at n_questions, hence a round is complete exactly once,
    however the notes were cut into batches.
    """
    once = matches.select("run_id", "round", "question_id", "n_questions").dropDuplicates(
        ["run_id", "round", "question_id"]
    )
    return (
        once.groupBy("run_id", "round")
        .agg(count_all().alias("answered"), F.max("n_questions").alias("n_questions"))
        .where(F.col("answered") == F.col("n_questions"))
    )


def drain_gate(notes: DataFrame, folder: str | None = None) -> DataFrame:
    """Both steps of the gate over all notes that are available."""
    spark = notes.sparkSession
    folder = folder or shared_folder(spark, "gate")
    matched = drain(question_matches(notes), "matches", "update", f"{folder}/matches")
    again = spark.readStream.schema(matched.schema).parquet(rows_path(f"{folder}/matches"))
    return drain(complete_rounds(again), "rounds", "update", f"{folder}/rounds")


def drain_status_changes(
    events: DataFrame, order: Sequence[str], folder: str | None = None, compact_every: int = 20
) -> DataFrame:
    """Rows where ``status:current_node`` of a run changed, over all events that are available.

    Inside a micro-batch this is the batch operator, so one busy run is spread
    over many tasks.  The last key of every run in a batch goes to a table;
    every ``compact_every`` batches it takes in all runs, so a batch looks back
    over a bounded number of earlier ones.  A repeated batch writes the same
    rows again.
    """
    spark = events.sparkSession
    folder = folder or shared_folder(spark, "status-changes")
    keyed = events.select("run_id", *order, runs.status_key().alias("status_key"))
    last_schema = T.StructType(
        [keyed.schema["run_id"], keyed.schema["status_key"], T.StructField("batch", T.LongType())]
    )

    def changed(batch: DataFrame, number: int) -> DataFrame:
        oldest = max(0, number - 1) // compact_every * compact_every
        earlier = read_drained(spark, f"{folder}/last", last_schema).where(
            F.col("batch").between(oldest, number - 1)
        )
        if number % compact_every:
            earlier = earlier.join(batch.select("run_id").distinct(), "run_id", "left_semi")
        last = earlier.groupBy("run_id").agg(F.max_by("status_key", "batch").alias("status_key"))
        # What was known before comes first, whatever the times in the batch.
        unset = [F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in order]
        both = batch.withColumn("_new", F.lit(1)).unionByName(
            last.select("run_id", *unset, "status_key").withColumn("_new", F.lit(0))
        )
        placed = ["_new", *order]
        seen = split_previous(both, ["run_id"], placed, F.col("status_key"), "_before")
        newest = both.groupBy("run_id").agg(
            F.max_by("status_key", F.struct(*placed)).alias("status_key"), F.max("_new").alias("_new")
        )
        if number % compact_every:
            newest = newest.where(F.col("_new") == 1)
        write_drained(newest.drop("_new"), f"{folder}/last", number)
        return seen.where((F.col("_new") == 1) & ~F.col("status_key").eqNullSafe(F.col("_before"))).drop("_new", "_before")

    write_drained(spark.createDataFrame([], T.StructType(last_schema.fields[:2])), f"{folder}/last", -1)
    return drain(keyed, "status-changes", folder=folder, each=changed)


def rows_by_day(events: DataFrame, ts: str, late: str | None = None) -> DataFrame:
    """Row counts per day, kept up to date.  Output mode: update.

    One state row per day, kept for ever.  ``late`` (such as "1 hour") sets a
    watermark and lets days be forgotten; rows later than that are then not
    counted, and zone-less times are read in the session time zone, which has
    to be UTC, because a watermark needs times with a zone.
    """
    if late is None:
        return events.groupBy(day(ts).alias("day")).agg(count_all().alias("n"), F.max(ts).alias("latest"))
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return (
        at.groupBy(F.window("_at", "1 day").alias("_day"))
        .agg(count_all().alias("n"), F.max("_at").alias("latest"))
        .select(F.to_date("_day.start").alias("day"), "n", "latest")
    )


def current(updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last update of every key out of drained update-mode rows."""
    columns = [c for c in updates.columns if c not in key and c != "batch"]
    newest = F.max_by(F.struct(*columns), "batch").alias("_row")
    return updates.groupBy(*key).agg(newest).select(*key, "_row.*")
