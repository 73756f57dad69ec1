"""Check suites, findings, suggestions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import report, rules, suggest, suite
from ..plans.suite import CheckSpec
from . import query, table
from .history import SEVERITY_SQL, finding_rows
from .tables import AS_OF, COLUMNS

SPECS = (
    CheckSpec("events_rows", "events", "row_count"),
    CheckSpec("events_fresh", "events", "freshness", ("ts",)),
    CheckSpec("events_type_nulls", "events", "nulls", ("event_type",)),
    CheckSpec("events_peak", "events", "range", ("value",), {"low": 0, "high": 200}),
    CheckSpec("events_kinds", "events", "accepted", ("event_type",), {"allowed": ["click", "view", "purchase", "signup"]}),
    CheckSpec("events_days", "events", "rows_by_day", ("ts",)),
    CheckSpec("events_no_column", "events", "freshness", ("data_collection_log_timestamp",)),
    CheckSpec("orders_rows", "orders", "row_count"),
    CheckSpec("orders_fresh", "orders", "freshness", ("o_orderdate",)),
    CheckSpec("orders_priorities", "orders", "distribution", ("o_orderpriority",)),
    CheckSpec("orders_grain", "orders", "duplicate_grain", ("o_orderkey",)),
    CheckSpec("lineitem_grain", "lineitem", "duplicate_grain", ("l_orderkey", "l_linenumber")),
    CheckSpec("lineitem_quantity", "lineitem", "range", ("l_quantity",), {"low": 1, "high": 45}),
    CheckSpec("lineitem_days", "lineitem", "rows_by_day", ("l_shipdate",)),
    CheckSpec("nowhere_rows", "nowhere", "row_count"),
)


def _days_sql(t: str, c: str) -> str:
    return (
        f"(WITH c AS (SELECT CAST({c} AS DATE) AS d, count(*) AS n FROM {t} GROUP BY 1 ORDER BY 1 DESC LIMIT 14),"
        " m AS (SELECT median(n) AS m FROM c) SELECT max(round(abs(n - m) / m, 6)) FROM c, m)"
    )


def _lag_sql(t: str, c: str) -> str:
    return f"(SELECT datesub('minute', max({c}), TIMESTAMP '{AS_OF}') FROM {t})"


def _groups_sql(t: str, keys: str, having: str = "") -> str:
    return f"(SELECT count(*) FROM (SELECT {keys} FROM {t} GROUP BY {keys} {having}))"


# check, category, table, kind, what is observed, number of result rows
_EVIDENCE_SQL = [
    ("events_rows", "row_count", "events", "row_count", "(SELECT count(*) FROM events)", "1"),
    ("events_fresh", "freshness", "events", "freshness", _lag_sql("events", "ts"), "1"),
    ("events_type_nulls", "null_check", "events", "nulls", "(SELECT count(*) FROM events WHERE event_type IS NULL)", "1"),
    ("events_peak", "business_rule", "events", "range",
     "(SELECT count(*) FROM events WHERE value < 0 OR value > 200)", "1"),
    ("events_kinds", "business_rule", "events", "accepted",
     "(SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup'))", "1"),
    ("events_days", "row_count", "events", "rows_by_day", _days_sql("events", "ts"),
     "(SELECT least(14, count(DISTINCT CAST(ts AS DATE))) FROM events)"),
    ("orders_rows", "row_count", "orders", "row_count", "(SELECT count(*) FROM orders)", "1"),
    ("orders_fresh", "freshness", "orders", "freshness", _lag_sql("orders", "o_orderdate"), "1"),
    ("orders_priorities", "business_rule", "orders", "distribution", _groups_sql("orders", "o_orderpriority"),
     _groups_sql("orders", "o_orderpriority")),
    ("orders_grain", "duplicate_grain", "orders", "duplicate_grain",
     _groups_sql("orders", "o_orderkey", "HAVING count(*) > 1"), _groups_sql("orders", "o_orderkey", "HAVING count(*) > 1")),
    ("lineitem_grain", "duplicate_grain", "lineitem", "duplicate_grain",
     _groups_sql("lineitem", "l_orderkey, l_linenumber", "HAVING count(*) > 1"),
     _groups_sql("lineitem", "l_orderkey, l_linenumber", "HAVING count(*) > 1")),
    ("lineitem_quantity", "business_rule", "lineitem", "range",
     "(SELECT count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45)", "1"),
    ("lineitem_days", "row_count", "lineitem", "rows_by_day", _days_sql("lineitem", "l_shipdate"),
     "(SELECT least(14, count(DISTINCT CAST(l_shipdate AS DATE))) FROM lineitem)"),
]
EVIDENCE_SQL = "evidence AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS check_id, '{c}' AS category, '{t}' AS target_table, '{k}' AS kind, 'ok' AS status,"
    f" CAST({seen} AS DOUBLE) AS observed, CAST({n} AS BIGINT) AS row_count"
    for i, c, t, k, seen, n in _EVIDENCE_SQL
) + """ UNION ALL SELECT 'events_no_column', 'freshness', 'events', 'freshness', 'skipped', NULL, NULL
    UNION ALL SELECT 'nowhere_rows', 'row_count', 'nowhere', 'row_count', 'skipped', NULL, NULL)"""


def suite_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in ("events", "orders", "lineitem")}


@query(f"""
    WITH {EVIDENCE_SQL}
    SELECT check_id, category, target_table, kind, status, coalesce(round(observed, 6), -1) AS observed,
           coalesce(row_count, -1) AS row_count FROM evidence
""")
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suite.evidence(spark, suite_tables(spark, sf_dir), SPECS, AS_OF)
    return found.select(
        "check_id", "category", "target_table", "kind", "status",
        F.coalesce(F.round("observed", 6), F.lit(-1.0)).alias("observed"),
        F.coalesce("row_count", F.lit(-1).cast("bigint")).alias("row_count"),
    )


#: Checks beside ``SPECS`` that meet what they cannot read, may not run, or compare tables.
MORE_SPECS = (
    CheckSpec("events_text_time", "events", "freshness", ("event_type",)),
    CheckSpec("events_text_range", "events", "range", ("props",), {"low": 0}),
    CheckSpec("events_schema", "events", "schema", (), {"expected": {
        "event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "gone": "int"}}),
    CheckSpec("events_complete", "events", "completeness", ("user_id", "ts"), {"minimum": 1, "first_day": "2024-01-03", "last_day": "2024-01-05"}),
    CheckSpec("events_coverage", "events", "coverage", ("user_id", "ts")),
    CheckSpec("orders_lines", "orders", "reconcile_keys", ("o_orderkey",), {"other": "lineitem", "other_columns": ("l_orderkey",)}),
    CheckSpec("orders_days", "orders", "reconcile_days", ("o_orderdate",), {"other": "lineitem", "other_columns": ("l_shipdate",)}),
    CheckSpec("orders_bad_type", "orders", "freshness", ("o_orderkey",)),
    CheckSpec("drop_orders", "orders", "sql", sql="DROP TABLE orders"),
)
_MORE_SQL = [
    ("events_schema", "schema", "events", "schema", "3", "3"),
    ("events_complete", "row_count", "events", "completeness", *[
        """(SELECT count(*) FROM (SELECT user_id, count(DISTINCT CASE WHEN ts >= '2024-01-03' AND ts < '2024-01-06' THEN CAST(ts AS DATE) END) AS n
           FROM events GROUP BY 1) WHERE n < 3)"""] * 2),
    ("events_coverage", "row_count", "events", "coverage", *[
        """(SELECT count(*) FROM (SELECT max(CAST(ts AS DATE)) AS d FROM events GROUP BY user_id) WHERE d < (SELECT max(CAST(ts AS DATE)) FROM events))"""] * 2),
    ("orders_lines", "reconciliation", "orders", "reconcile_keys", *[
        """((SELECT count(DISTINCT o_orderkey) FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey)
          + (SELECT count(DISTINCT l_orderkey) FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey))"""] * 2),
    ("orders_days", "reconciliation", "orders", "reconcile_days", *[
        """(SELECT count(*) FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) a
            FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d
            WHERE coalesce(a.n, 0) <> coalesce(b.n, 0))"""] * 2),
]
_UNREAD = "(SELECT concat(count({c}), ' values of {c} are no {t}') FROM events)"


@query(f"""
    WITH {EVIDENCE_SQL},
    more AS ({" UNION ALL ".join(
        f"SELECT '{i}' AS check_id, '{c}' AS category, '{t}' AS target_table, '{k}' AS kind, 'ok' AS status,"
        f" CAST({seen} AS DOUBLE) AS observed, CAST({n} AS BIGINT) AS row_count, '' AS error" for i, c, t, k, seen, n in _MORE_SQL)}),
    bad AS (SELECT 'events_text_time' AS check_id, 'freshness' AS category, 'events' AS target_table, 'freshness' AS kind,
                   {_UNREAD.format(c="event_type", t="timestamp")} AS error
            UNION ALL SELECT 'events_text_range', 'business_rule', 'events', 'range', {_UNREAD.format(c="props", t="number")}),
    every AS (SELECT *, '' AS error FROM evidence UNION ALL SELECT * FROM more
              UNION ALL SELECT check_id, category, target_table, kind, 'failed', NULL, NULL, error FROM bad
              UNION ALL SELECT 'orders_bad_type', 'freshness', 'orders', 'freshness', 'skipped', NULL, NULL, ''
              UNION ALL SELECT 'drop_orders', 'business_rule', 'orders', 'sql', 'rejected', NULL, NULL, '')
    SELECT check_id, category, target_table, kind, status, coalesce(round(observed, 6), -1) AS observed,
           coalesce(row_count, -1) AS row_count, error, status = 'ok' AS timed FROM every
""")
def suite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite with failing, rejected and skipped checks: each is a record, and a table is scanned once for its single values."""
    found = suite.run_suite(spark, suite_tables(spark, sf_dir), SPECS + MORE_SPECS, AS_OF)
    return found.select(
        "check_id", "category", "target_table", "kind", "status",
        F.coalesce(F.round("observed", 6), F.lit(-1.0)).alias("observed"),
        F.coalesce("row_count", F.lit(-1).cast("bigint")).alias("row_count"),
        F.when(F.col("status") == "failed", F.col("error")).otherwise("").alias("error"),
        ((F.col("status") == "ok") & (F.col("runtime_ms") >= 0)).alias("timed"),
    )


_BANDS_SQL = ", ".join(f"('{k}', {p}::DOUBLE, {w}::DOUBLE, '{m}', '{a}')" for k, p, w, m, a in rules.DEFAULT_BANDS)


@query(f"""
    WITH {EVIDENCE_SQL}, bands(kind, pass_to, warn_to, measured, action) AS (VALUES {_BANDS_SQL}),
    j AS (SELECT e.*, b.pass_to, b.measured, b.action,
                 CASE WHEN status <> 'ok' THEN 'warn' WHEN pass_to IS NULL THEN 'pass' WHEN observed IS NULL AND e.kind = 'freshness' THEN 'fail'
                      WHEN observed IS NULL THEN 'warn' WHEN observed <= pass_to THEN 'pass'
                      WHEN observed <= warn_to THEN 'warn' ELSE 'fail' END AS severity
          FROM evidence e LEFT JOIN bands b ON e.kind = b.kind)
    SELECT concat(kind, ' of ', target_table, ': ', severity) AS title, severity,
           CASE WHEN status = 'ok' AND pass_to IS NULL THEN concat(kind, ': no bounds')
                WHEN status = 'ok' THEN concat(measured, ': ', printf('%.6f', observed), ' (passes up to ',
                printf('%.6f', pass_to), ')') ELSE concat('not run: ', status) END AS evidence,
           CASE WHEN severity = 'pass' THEN 'no action' ELSE coalesce(action, 'see why the check did not run') END AS recommended_action,
           check_id AS related_check, target_table AS related_table
    FROM j
""")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suite.evidence(spark, suite_tables(spark, sf_dir), SPECS, AS_OF)
    return rules.findings(found, rules.bands(spark))


_SUGGEST_TABLES = ("events", "orders", "customer", "supplier")
_NUMERIC = ("int", "bigint", "double")


def _profile_sql() -> str:
    rows = []
    for t in _SUGGEST_TABLES:
        for i, (c, kind) in enumerate(COLUMNS[t].items()):
            low = f"CAST(min({c}) AS DOUBLE)" if kind in _NUMERIC else "NULL"
            rows.append(
                f"SELECT '{t}' AS table_id, {i} AS ordinal, '{c}' AS col, '{kind}' AS type, count(*) AS n,"
                f" count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS d, {low} AS low FROM {t}"
            )
    return "profile AS (" + " UNION ALL ".join(rows) + ")"


_SUGGEST_SQL = f"""WITH {_profile_sql()},
    p AS (SELECT *, type LIKE 'timestamp%' AS is_time, type IN ('int', 'bigint', 'string') AND n > 0 AND d >= n * 0.97 AS uniq,
                 row_number() OVER (PARTITION BY table_id, type LIKE 'timestamp%' ORDER BY ordinal) = 1 AS is_first,
                 concat(chr(96), col, chr(96)) AS c, concat(chr(96), table_id, chr(96)) AS t FROM profile),
    s AS (
        SELECT *, 1 AS priority, 'freshness' AS kind, 'freshness' AS category,
               concat('SELECT MAX(', c, ') AS latest FROM ', t) AS sql FROM p WHERE is_time AND is_first
        UNION ALL SELECT *, 2, 'rows_by_day', 'row_count', concat('SELECT CAST(', c, ' AS DATE) AS d, COUNT(*) AS c FROM ', t,
               ' GROUP BY 1 ORDER BY 1 DESC LIMIT 14') FROM p WHERE is_time AND is_first
        UNION ALL SELECT *, 3, 'duplicate_grain', 'duplicate_grain', concat('SELECT ', c, ', COUNT(*) AS c FROM ', t,
               ' GROUP BY 1 HAVING COUNT(*) > 1 LIMIT 10') FROM p WHERE uniq
        UNION ALL SELECT *, 4, 'distribution', 'business_rule', concat('SELECT ', c, ', COUNT(*) AS c FROM ', t,
               ' GROUP BY 1 ORDER BY 2 DESC LIMIT 10') FROM p
               WHERE type IN ('int', 'bigint', 'string') AND n > 0 AND d <= 20 AND NOT uniq
        UNION ALL SELECT *, 5, 'range', 'business_rule', concat('SELECT COUNT(*) AS outside FROM ', t, ' WHERE ', c, ' < 0')
               FROM p WHERE low >= 0 AND NOT uniq
        UNION ALL SELECT *, 6, 'nulls', 'null_check', concat('SELECT COUNT(*) AS null_rows FROM ', t, ' WHERE ', c, ' IS NULL')
               FROM p WHERE nulls = 0 AND n > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY priority, ordinal) AS table_rank FROM s)
    SELECT table_id, col AS "column", concat('chk_', kind, '_', table_id, '_', col) AS id, kind, category, priority, sql,
           table_rank FROM r"""


def _suggested(spark: SparkSession, sf_dir: str, **cut: int) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in _SUGGEST_TABLES}
    return suggest.suggest_checks(suggest.column_profile(tables), **cut).select(
        "table_id", "column", "id", "kind", "category", "priority", "sql", "table_rank"
    )


@query(_SUGGEST_SQL)
def suggest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggested(spark, sf_dir)


@query(_SUGGEST_SQL + f" WHERE table_rank <= {suggest.SHORT_PER_TABLE} ORDER BY table_rank, table_id LIMIT {suggest.SHORT_RUN}")
def suggest_checks_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short run: two checks per table, six in all."""
    return _suggested(spark, sf_dir, per_table=suggest.SHORT_PER_TABLE, limit=suggest.SHORT_RUN)


@query(f"""
    WITH f AS (SELECT user_id AS run_id, {SEVERITY_SQL} AS severity, concat(event_type, ' #', event_id) AS title,
                      props AS evidence, CASE event_type WHEN 'error' THEN 'fix the load' WHEN 'purchase' THEN 'watch it'
                      WHEN 'click' THEN 'no action' END AS action FROM events),
    u AS (SELECT o_custkey AS run_id, concat('tbl', o_orderkey) AS table_id, o_orderpriority AS description,
                 o_orderstatus = 'P' AS parsing_failed FROM orders),
    k AS (SELECT run_id, CASE severity WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'pass' THEN 2 ELSE 3 END AS sev, f.* EXCLUDE (run_id) FROM f),
    totals AS (
        SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(tables, 0) AS tables, coalesce(pass, 0) AS pass,
               coalesce(warn, 0) AS warn, coalesce(fail, 0) AS fail
        FROM (SELECT run_id, count(*) FILTER (severity = 'pass') AS pass, count(*) FILTER (severity = 'warn') AS warn,
                     count(*) FILTER (severity = 'fail') AS fail FROM f GROUP BY 1) a
        FULL OUTER JOIN (SELECT run_id, count(*) AS tables FROM u WHERE NOT parsing_failed GROUP BY 1) b
        ON a.run_id = b.run_id)
    SELECT run_id, 1 AS section, 0 AS "rank", '# Data QA Report' AS line FROM totals
    UNION ALL SELECT run_id, 2, 0, concat('Reviewed ', tables, ' tables. Severity summary: ', pass, ' pass, ', warn,
              ' warn, ', fail, ' fail.') FROM totals
    UNION ALL SELECT run_id, 3, 0, concat('- **', table_id, '** — ', description) FROM u WHERE NOT parsing_failed
    UNION ALL SELECT run_id, 4, 0, concat('- not characterised: ', table_id) FROM u WHERE parsing_failed
    UNION ALL SELECT run_id, 5, sev, concat('- [', upper(severity), '] ', title, ' — ', evidence) FROM k
    UNION ALL SELECT run_id, 6, min(sev), concat('- ', action) FROM k
              WHERE action IS NOT NULL AND action <> 'no action' GROUP BY run_id, action
""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.expr(
        "CASE event_type WHEN 'error' THEN 'fix the load' WHEN 'purchase' THEN 'watch it' WHEN 'click' THEN 'no action' END"
    )
    found = finding_rows(spark, sf_dir).select(
        "run_id", "severity", F.concat("event_type", F.lit(" #"), "event_id").alias("title"),
        F.col("props").alias("evidence"), action.alias("recommended_action"), F.col("ts").alias("created_at"),
    )
    known = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.concat(F.lit("tbl"), "o_orderkey").alias("table_id"),
        F.col("o_orderpriority").alias("business_description"), (F.col("o_orderstatus") == "P").alias("parsing_failed"),
    )
    return report.report_lines(found, known).select("run_id", "section", "rank", "line")
