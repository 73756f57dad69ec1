"""Run history: logs, versions, open questions, lists and snapshots.

Customers are runs, their orders are the questions of the run and line items
the answers; events are the executions and findings of a run, or versions of a
table understanding, as each operator needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import count_all
from ..operators import runs, versions
from ..session import shared_folder
from ..sources import catalog, logs
from . import query, table

SEVERITY_SQL = """CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'pass' WHEN 'purchase' THEN 'warn'
    WHEN 'error' THEN 'fail' ELSE 'PASS' END"""


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.expr(SEVERITY_SQL).alias("severity"), "event_type", "event_id", "ts", "props"
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.where_equal(table(spark, sf_dir, "orders"), o_orderstatus="O").select("o_orderkey", "o_custkey")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def project_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.without(table(spark, sf_dir, "documents"), "text", "embedding", "_id")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = runs.where_equal(table(spark, sf_dir, "orders"), o_orderpriority="1-URGENT").select("o_orderkey")
    return runs.semi_in(table(spark, sf_dir, "lineitem"), "l_orderkey", urgent).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


_PARSED_SQL = "CASE event_type WHEN 'error' THEN true WHEN 'view' THEN NULL ELSE false END"


@query(f"""
    SELECT event_id, user_id AS table_id, CASE WHEN coalesce({_PARSED_SQL}, false) THEN 'skipped' ELSE 'usable' END AS part
    FROM events
""")
def split_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("table_id"), F.expr(_PARSED_SQL).alias("parsing_failed")
    )
    parts = runs.usable(rows).withColumn("part", F.lit("usable")).unionAll(
        runs.skipped(rows).withColumn("part", F.lit("skipped"))
    )
    return runs.without(parts, "parsing_failed")


_SOURCE_SQL = "CASE event_type WHEN 'click' THEN 'webapp' WHEN 'view' THEN NULL ELSE 'daemon' END"
_RUN_SQL = "CASE WHEN event_type = 'signup' THEN NULL ELSE concat('run-', event_id) END"


@query(f"""
    SELECT event_id, run_id FROM (SELECT event_id, {_RUN_SQL} AS run_id, {_SOURCE_SQL} AS run_source FROM events)
    WHERE run_id IS NOT NULL AND run_source IS DISTINCT FROM 'webapp'
""")
def route_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.expr(_RUN_SQL).alias("run_id"), F.expr(_SOURCE_SQL).alias("run_source")
    )
    return runs.without(runs.for_daemon(rows), "run_source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.year("o_orderdate").alias("round"),
        F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("table_id"),
        F.col("o_orderpriority").alias("question"), F.col("o_orderdate").alias("created_at"),
    )


# The last answer of a question wins; the other columns only break ties.
_ANSWER_ORDER = ("answered_at", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
ANSWERS_SQL = """answers AS (
    SELECT l_orderkey AS question_id, answered_at, l_linenumber, l_partkey, l_suppkey, l_returnflag,
           CASE WHEN l_returnflag = 'R' THEN '   ' ELSE concat(' part ', l_partkey, ' ') END AS answer
    FROM (SELECT *, l_shipdate AS answered_at, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) AS rn
          FROM lineitem) WHERE rn = 1)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current answer of every question, out of all that were given."""
    given = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_shipdate").alias("answered_at"), "l_linenumber",
        "l_partkey", "l_suppkey", "l_returnflag",
    )
    current = logs.last_write(given, ["question_id"], _ANSWER_ORDER)
    text = F.when(F.col("l_returnflag") == "R", "   ").otherwise(F.concat(F.lit(" part "), "l_partkey", F.lit(" ")))
    return current.withColumn("answer", text)


def answers_with_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select("question_id", "run_id")
    return answers(spark, sf_dir).join(asked, "question_id").select("run_id", "question_id", "answer", "answered_at")


@query("""
    SELECT o_custkey AS run_id, o_orderkey AS question_id, o_orderdate AS created_at
    FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey
""")
def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "question_id")
    return runs.unanswered(questions(spark, sf_dir), given, ["question_id"]).select(
        "run_id", "question_id", "created_at"
    )


_REFERENCE_SQL = "CASE WHEN value > 10 THEN event_type ELSE concat('check ', event_type) END"


@query(f"""
    WITH checks AS (
        SELECT DISTINCT user_id AS run_id, event_type AS query_id, concat('check ', event_type) AS check_name FROM events
        UNION ALL SELECT DISTINCT user_id, 'schema', 'check schema' FROM events),
    f AS (SELECT user_id AS run_id, {_REFERENCE_SQL} AS ref, concat(event_type, ' #', event_id) AS title,
                 row_number() OVER (PARTITION BY user_id, {_REFERENCE_SQL} ORDER BY ts, event_id) AS pos FROM events),
    g AS (SELECT run_id, ref, (pos - 1) // 10 AS chunk, count(*) AS n_findings,
                 string_agg(title, '; ' ORDER BY pos) AS supports FROM f GROUP BY 1, 2, 3),
    l AS (SELECT c.run_id, c.query_id, CASE WHEN g.ref = c.query_id THEN 'id' ELSE 'name' END AS matched_by,
                 g.chunk, g.n_findings, g.supports
          FROM checks c JOIN g ON g.run_id = c.run_id AND (g.ref = c.query_id OR g.ref = c.check_name))
    SELECT c.run_id, c.query_id, c.check_name, coalesce(l.matched_by, '') AS matched_by, coalesce(l.chunk, 0) AS chunk,
           coalesce(l.n_findings, 0) AS n_findings, coalesce(l.supports, '') AS supports
    FROM checks c LEFT JOIN l ON l.run_id = c.run_id AND l.query_id = c.query_id
""")
def findings_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id")
    own = events.select("run_id", F.col("event_type").alias("query_id")).distinct()
    checks = own.unionAll(own.select("run_id").distinct().withColumn("query_id", F.lit("schema"))).select(
        "run_id", "query_id", F.concat(F.lit("check "), "query_id").alias("check_name"), F.lit("ok").alias("status")
    )
    found = events.select(
        "run_id", F.expr(_REFERENCE_SQL).alias("related_check"),
        F.concat("event_type", F.lit(" #"), "event_id").alias("title"), "ts", "event_id",
    )
    attached = runs.findings_by_check(checks, found, ["ts", "event_id"], chunk_size=10)
    return attached.drop("status").na.fill("")


_ROLLUP_SQL = """rollups AS (
    SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'A') AS pass,
           count(*) FILTER (l_returnflag = 'N') AS warn, count(*) FILTER (l_returnflag = 'R') AS fail
    FROM lineitem GROUP BY 1)"""


@query(f"""
    WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderpriority AS current_node,
                      CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS started_at,
                      o_orderdate + INTERVAL 2 HOUR AS updated_at FROM orders),
    {_ROLLUP_SQL},
    page AS (SELECT * FROM r ORDER BY started_at DESC NULLS LAST, updated_at DESC NULLS LAST, run_id LIMIT 50)
    SELECT run_id, status, current_node, started_at, updated_at, coalesce(pass, 0) AS pass, coalesce(warn, 0) AS warn,
           coalesce(fail, 0) AS fail
    FROM page LEFT JOIN rollups USING (run_id)
""")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("current_node"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("started_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")).alias("updated_at"),
    )
    found = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'warn' ELSE 'fail' END").alias("severity"),
    )
    return runs.run_list(rows, runs.severity_rollup(found), limit=100)


_ROUNDS_SQL = f"""q AS (
    SELECT o_custkey AS run_id, CAST(year(o_orderdate) AS INT) AS round, o_orderkey AS question_id,
           o_orderstatus AS table_id, o_orderpriority AS question, o_orderdate AS asked_at,
           count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n_questions FROM orders),
    {ANSWERS_SQL}"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the number of questions of their round."""
    asked = questions(spark, sf_dir)
    sizes = asked.groupBy("run_id", "round").agg(count_all().alias("n_questions"))
    return asked.join(sizes, ["run_id", "round"]).withColumnRenamed("created_at", "asked_at")


@query(f"""
    WITH {_ROUNDS_SQL},
    m AS (SELECT q.*, a.answer FROM q JOIN answers a USING (question_id)),
    c AS (SELECT run_id, round FROM m GROUP BY 1, 2 HAVING count(*) >= max(n_questions))
    SELECT m.run_id, m.round, m.question_id, m.table_id, m.question, m.answer, m.asked_at
    FROM m SEMI JOIN c ON m.run_id = c.run_id AND m.round = c.round
""")
def answers_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.answers_complete(rounds(spark, sf_dir), answers(spark, sf_dir), ["question_id"])


@query(f"""
    WITH {ANSWERS_SQL},
    a AS (SELECT o_custkey AS run_id, count(*) AS n FROM answers JOIN orders ON o_orderkey = question_id GROUP BY 1),
    u AS (SELECT o_custkey AS run_id, count(*) AS n FROM orders ANTI JOIN answers ON o_orderkey = question_id GROUP BY 1),
    e AS (SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY 1),
    f AS (SELECT user_id AS run_id, count(*) FILTER ({SEVERITY_SQL} = 'pass') AS pass,
                 count(*) FILTER ({SEVERITY_SQL} = 'warn') AS warn, count(*) FILTER ({SEVERITY_SQL} = 'fail') AS fail,
                 count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT c_custkey AS run_id, coalesce(u.n, 0) AS pending_questions, coalesce(a.n, 0) AS answered_questions,
           coalesce(e.n, 0) AS executed_queries, coalesce(f.n, 0) AS findings, coalesce(pass, 0) AS pass,
           coalesce(warn, 0) AS warn, coalesce(fail, 0) AS fail
    FROM customer LEFT JOIN a ON a.run_id = c_custkey LEFT JOIN u ON u.run_id = c_custkey
    LEFT JOIN e ON e.run_id = c_custkey LEFT JOIN f ON f.run_id = c_custkey
""")
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = finding_rows(spark, sf_dir).where(F.col("event_type") != "view")
    return runs.run_counts(
        runs=table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")),
        questions=questions(spark, sf_dir),
        answers=answers_with_run(spark, sf_dir),
        executions=table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")),
        findings=found,
        rollups=runs.severity_rollup(found),
    )


@query(f"""
    WITH {ANSWERS_SQL},
    j AS (SELECT o_custkey AS run_id, a.question_id IS NULL AS is_missing,
                 a.question_id IS NOT NULL AND trim(a.answer) = '' AS is_blank
          FROM orders LEFT JOIN answers a ON a.question_id = o_orderkey)
    SELECT run_id, count(*) AS pending, count(*) FILTER (is_missing) AS missing, count(*) FILTER (is_blank) AS blank,
           CASE WHEN count(*) FILTER (is_missing) > 0 THEN 'missing_answers'
                WHEN count(*) FILTER (is_blank) > 0 THEN 'blank_answer' ELSE 'accepted' END AS verdict
    FROM j GROUP BY 1
""")
def validate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.validate_answers(questions(spark, sf_dir), answers_with_run(spark, sf_dir))


@query(f"""
    SELECT user_id AS run_id, count(*) FILTER (s = 'pass') AS pass, count(*) FILTER (s = 'warn') AS warn,
           count(*) FILTER (s = 'fail') AS fail
    FROM (SELECT user_id, {SEVERITY_SQL} AS s FROM events) GROUP BY 1
""")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.severity_rollup(finding_rows(spark, sf_dir))


@query("""
    SELECT user_id AS table_id, event_id AS version, event_type, value FROM events
    WHERE (user_id, event_id) IN (SELECT user_id, max(event_id) FROM events GROUP BY 1)
""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("table_id"), F.col("event_id").alias("version"), "event_type", "value"
    )
    return versions.latest_version(rows)


@query("""
    WITH stored AS (SELECT o_custkey AS table_id, count(*) AS version FROM orders GROUP BY 1)
    SELECT event_id, user_id AS table_id,
           coalesce(s.version, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version
    FROM events LEFT JOIN stored s ON s.table_id = user_id
""")
def assign_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("table_id")).agg(count_all().alias("version"))
    incoming = table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), "event_id", "ts")
    numbered = versions.assign_versions(incoming, stored, ["ts", "event_id"])
    return numbered.select("event_id", "table_id", "version")


_STATUS_KEY_SQL = "concat(o_orderstatus, ':', o_orderpriority)"


@query(f"""
    SELECT run_id, o_orderkey, status_key
    FROM (SELECT o_custkey AS run_id, o_orderkey, {_STATUS_KEY_SQL} AS status_key,
                 lag({_STATUS_KEY_SQL}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
    WHERE before IS DISTINCT FROM status_key
""")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("current_node"),
    )
    return runs.status_changes(seen, ["o_orderdate", "o_orderkey"]).select("run_id", "o_orderkey", "status_key")


@query("""
    SELECT table_id, CAST(min(list_no) AS INT) AS list_no, arg_min(position, (list_no, position)) AS position
    FROM (SELECT concat('tbl', user_id) AS table_id, 0 AS list_no, event_id AS position FROM events
          UNION ALL SELECT concat('tbl', o_custkey), 1, o_orderkey FROM orders) GROUP BY 1
""")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "events").select(
        F.concat(F.lit("tbl"), "user_id").alias("table_id"), F.col("event_id").alias("position")
    )
    targets = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tbl"), "o_custkey").alias("table_id"), F.col("o_orderkey").alias("position")
    )
    return catalog.union_distinct(sources, targets)


# Which fields an update sets depends on its kind; a large amount is reset to null.
_PRESENT_SQL = {"status": "('click', 'view', 'signup')", "amount": "('view', 'purchase')",
                "note": "('purchase', 'error', 'signup')"}
_AMOUNT_SQL = "CASE WHEN value > 20 THEN NULL ELSE value END"


@query(f"""
    WITH u AS (SELECT user_id, ts, event_id, event_type AS status, {_AMOUNT_SQL} AS amount, props AS note FROM events),
    s AS (SELECT user_id, arg_max(status, (ts, event_id)) AS status FROM u WHERE status IN {_PRESENT_SQL['status']} GROUP BY 1),
    a AS (SELECT user_id, amount FROM (SELECT user_id, amount, row_number() OVER (PARTITION BY user_id
            ORDER BY ts DESC, event_id DESC) AS rn FROM u WHERE status IN {_PRESENT_SQL['amount']}) WHERE rn = 1),
    n AS (SELECT user_id, arg_max(note, (ts, event_id)) AS note FROM u WHERE status IN {_PRESENT_SQL['note']} GROUP BY 1),
    k AS (SELECT user_id, max(ts) AS updated_at FROM u GROUP BY 1)
    SELECT k.user_id, coalesce(s.status, '') AS status, coalesce(a.amount, -1) AS amount, coalesce(n.note, '') AS note,
           k.updated_at
    FROM k LEFT JOIN s USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN n USING (user_id)
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.array_compact(F.array(*[
        F.when(F.expr(f"event_type IN {kinds}"), F.lit(name)) for name, kinds in _PRESENT_SQL.items()
    ]))
    log = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.col("event_type").alias("status"), F.expr(_AMOUNT_SQL).alias("amount"),
        F.col("props").alias("note"), present.alias("present"),
    )
    merged = logs.upsert_merge(log, ["user_id"], ["status", "amount", "note"], ["ts", "event_id"])
    return merged.na.fill("").na.fill(-1.0)


@query("""
    SELECT event_id, user_id FROM events
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
""")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stopped = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("user_id"))
    return logs.delete_by_key(table(spark, sf_dir, "events").select("event_id", "user_id"), stopped, ["user_id"])


@query("""
    SELECT CAST(d AS VARCHAR) AS "day", count(*) AS n,
           round(sum(CASE WHEN d >= DATE '2024-01-25' THEN value * 2 ELSE value END), 2) AS total
    FROM (SELECT CAST(ts AS DATE) AS d, value FROM events) GROUP BY 1
""")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all days, process the last days again twice, read back."""
    folder = shared_folder(spark, "partition-overwrite")
    days = table(spark, sf_dir, "events").select("event_id", "value", F.col("ts").cast("date").alias("day"))
    logs.overwrite_partitions(days.hint("rebalance", "day"), folder, ["day"])
    again = days.where(F.col("day") >= F.lit("2024-01-25").cast("date")).withColumn("value", F.col("value") * 2)
    for _ in range(2):
        logs.overwrite_partitions(again.hint("rebalance", "day"), folder, ["day"])
    back = logs.read_log(spark, folder, "event_id bigint, value double, day date")
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(
        count_all().alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("""
    SELECT event_type AS category, count(*) AS executions, count(DISTINCT user_id) AS runs FROM events GROUP BY 1
""")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to an execution log, read back as one."""
    folder = shared_folder(spark, "append-log")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("category"), F.col("user_id").alias("run_id"), "event_id"
    )
    bad = F.col("category") == "error"
    for part in (rows.where(~bad), rows.where(bad)):
        logs.append_log(part, folder, ["category"])
    back = logs.read_log(spark, folder, "run_id bigint, event_id bigint, category string")
    per_run = back.groupBy("category", "run_id").agg(count_all().alias("n"))
    return per_run.groupBy("category").agg(F.sum("n").alias("executions"), count_all().alias("runs"))
