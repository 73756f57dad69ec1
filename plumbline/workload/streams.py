"""The feeds, drained over the benchmark tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import feeds, retention
from ..streaming.runner import drain, open_stream
from . import query, table
from .history import _ROUNDS_SQL, questions, rounds


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return open_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", table(spark, sf_dir, name).schema)


_OPERATION_SQL = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'update' ELSE 'insert' END"
_STATUS_SQL = "CASE WHEN value > 5 THEN 'pending' ELSE 'running' END"
_OWNER_SQL = "CASE WHEN event_type = 'click' THEN 'webapp' END"


@query(f"""
    SELECT DISTINCT user_id AS run_id FROM events
    WHERE {_OPERATION_SQL} IN ('insert', 'update', 'replace') AND {_STATUS_SQL} = 'pending'
      AND {_OWNER_SQL} IS DISTINCT FROM 'webapp'
""")
def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _stream(spark, sf_dir, "events").select(
        F.expr(_OPERATION_SQL).alias("operation"), F.expr(_STATUS_SQL).alias("status"),
        F.expr(_OWNER_SQL).alias("run_source"), F.col("user_id").alias("run_id"),
    )
    return drain(feeds.pending_runs(changes).select("run_id"), "stream-pending").select("run_id")


@query(f"""
    SELECT DISTINCT user_id AS run_id, props AS question_id FROM events WHERE {_OPERATION_SQL} = 'insert'
""")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _stream(spark, sf_dir, "events").select(
        F.expr(_OPERATION_SQL).alias("operation"), F.col("user_id").alias("run_id"), F.col("props").alias("question_id")
    )
    return drain(feeds.new_answers(changes), "stream-answers").select("run_id", "question_id")


@query(f"""
    WITH {_ROUNDS_SQL}
    SELECT run_id, round, count(*) AS answered, max(n_questions) AS n_questions
    FROM q JOIN answers USING (question_id) GROUP BY 1, 2 HAVING count(*) >= max(n_questions)
""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask, line items answer; the size of a round is looked up in a table."""
    sizes = rounds(spark, sf_dir).select("run_id", "round", "question_id", "n_questions")
    # An answer needs no size, so the rounds are counted once only.
    known = questions(spark, sf_dir).dropna(subset=["run_id", "round"]).select("run_id", "round", "question_id")
    asked = (
        _stream(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"))
        .join(sizes, "question_id")
        .select(F.lit("question").alias("kind"), "run_id", "round", "question_id", "n_questions")
    )
    answered = (
        _stream(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"))
        .join(known, "question_id")
        .select(
            F.lit("answer").alias("kind"), "run_id", "round", "question_id",
            F.lit(None).cast("bigint").alias("n_questions"),
        )
    )
    return feeds.drain_gate(asked.unionByName(answered)).drop("batch")


_KEY_SQL = "concat(o_orderstatus, ':', o_orderpriority)"


@query(f"""
    SELECT run_id, o_orderkey, status_key
    FROM (SELECT o_custkey AS run_id, o_orderkey, {_KEY_SQL} AS status_key,
                 lag({_KEY_SQL}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
    WHERE before IS DISTINCT FROM status_key
""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _stream(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("current_node"),
    )
    changes = feeds.drain_status_changes(seen, ["o_orderdate", "o_orderkey"])
    return changes.select("run_id", "o_orderkey", "status_key")


@query("""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", count(*) AS n FROM events GROUP BY 1
""")
def stream_rows_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = drain(feeds.rows_by_day(_stream(spark, sf_dir, "events"), "ts"), "stream-rows-by-day", "update")
    return feeds.current(updates, ["day"]).select(F.col("day").cast("string").alias("day"), "n")


@query(f"""
    WITH RECURSIVE e AS (
        SELECT DISTINCT user_id AS run_id, date_trunc('millisecond', ts) AS seen FROM events
        WHERE {_OPERATION_SQL} IN ('insert', 'update', 'replace') AND {_STATUS_SQL} = 'pending'
          AND {_OWNER_SQL} IS DISTINCT FROM 'webapp'),
    s AS (
        SELECT run_id, min(seen) AS seen FROM e GROUP BY 1
        UNION ALL
        SELECT s.run_id, min(e.seen) FROM s JOIN e ON e.run_id = s.run_id AND e.seen >= s.seen + INTERVAL 3 DAY GROUP BY s.run_id)
    SELECT run_id, CAST(seen AS VARCHAR) AS shown_at FROM s
""")
def stream_pending_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of pending runs in four landings, each a micro-batch or more; a run shows again three days after it was shown."""
    events = table(spark, sf_dir, "events").where("ts is not null")
    edges = _edges(events)
    folder, checkpoint = shared_folder(spark, "landed"), shared_folder(spark, "pending-again")
    found = None
    for low, high in zip(edges[:-1], edges[1:]):
        part = events.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        part.write.mode("append").parquet(folder)
        changes = open_stream(spark, folder, events.schema).select(
            F.expr(_OPERATION_SQL).alias("operation"), F.expr(_STATUS_SQL).alias("status"),
            F.expr(_OWNER_SQL).alias("run_source"), F.col("user_id").alias("run_id"), "ts",
        )
        found = drain(retention.pending_again(changes, "ts", 3 * 24 * 60), "pending-again", folder=checkpoint)
    return found.select("run_id", F.col("shown_at").cast("string").alias("shown_at"))


def _edges(events: DataFrame, parts: int = 4) -> list:
    """Moments that cut the time of the events into equal parts."""
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / parts
    return [low + i * step for i in range(parts)] + [high + (step or datetime.timedelta(days=1))]
