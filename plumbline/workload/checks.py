"""Grouping checks, day-to-day stability and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups, reconcile
from ..operators.profile import union_all
from ..plans import pipeline
from . import query, table
from .tables import GOLD_SQL, SILVER_SQL, silver

_DAYS_SQL = "SELECT CAST(ts AS DATE) AS \"day\", count(*) AS n FROM events GROUP BY 1"


def _day_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT CAST("day" AS VARCHAR) AS "day", n FROM ({_DAYS_SQL} ORDER BY 1 DESC LIMIT 14)""")
def rows_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(groups.rows_by_day(table(spark, sf_dir, "events"), "ts"))


@query(f"""
    WITH c AS ({_DAYS_SQL} ORDER BY 1 DESC LIMIT 14), m AS (SELECT median(n) AS median_n FROM c),
    d AS (SELECT "day", n, median_n, round(abs(n - median_n) / median_n, 6) AS deviation FROM c, m)
    SELECT CAST("day" AS VARCHAR) AS "day", n, median_n, deviation,
           CASE WHEN deviation <= 0.05 THEN 'pass' WHEN deviation <= 0.2 THEN 'warn' ELSE 'fail' END AS severity
    FROM d
""")
def median_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(groups.median_deviation(groups.rows_by_day(table(spark, sf_dir, "events"), "ts")))


@query(f"""
    WITH c AS ({_DAYS_SQL}), p AS (SELECT *, lag(n) OVER (ORDER BY "day") AS previous_n FROM c)
    SELECT CAST("day" AS VARCHAR) AS "day", n, coalesce(previous_n, 0) AS previous_n,
           coalesce(n - previous_n, 0) AS change,
           coalesce(round((n - previous_n)::DOUBLE / previous_n, 6), 0) AS change_share
    FROM p
""")
def day_over_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = groups.rows_by_day(table(spark, sf_dir, "events"), "ts", None)
    return _day_as_text(groups.day_over_day(counts)).na.fill(0)


@query(f"""
    WITH c AS ({_DAYS_SQL}), m AS (SELECT median(n) AS median_n FROM c),
    s AS (SELECT "day", n, median_n, n < median_n * CAST(0.95 AS DOUBLE) AS short,
                 TIMESTAMP '2024-01-31 08:00:00' >= CAST("day" AS TIMESTAMP) + INTERVAL 33 HOUR AS complete_expected
          FROM c, m)
    SELECT CAST("day" AS VARCHAR) AS "day", n, median_n, complete_expected,
           CASE WHEN NOT short THEN 'pass' WHEN complete_expected THEN 'fail' ELSE 'warn' END AS severity
    FROM s
""")
def cutoff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = groups.rows_by_day(table(spark, sf_dir, "events"), "ts", None)
    return _day_as_text(groups.cutoff_status(counts, "2024-01-31 08:00:00"))


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    ORDER BY 3 DESC, 1, 2 LIMIT 10
""")
def dup_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.duplicate_grain(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_GRAINS = (("lineitem", ("l_orderkey", "l_linenumber")), ("orders", ("o_orderkey",)), ("events", ("user_id", "ts")))


@query(" UNION ALL ".join(
    f"""SELECT '{t}' AS table_id, '{",".join(g)}' AS grain, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS groups,
        round((sum(n) - count(*))::DOUBLE / sum(n)::DOUBLE, 6) AS duplicate_share, sum(n) = count(*) AS is_unique
        FROM (SELECT count(*) AS n FROM {t} GROUP BY {",".join(g)})"""
    for t, g in _GRAINS
))
def grain_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(groups.grain_ratio(table(spark, sf_dir, t), t, g) for t, g in _GRAINS)


@query("""
    SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.accepted_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""
    SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
    GROUP BY 1
""")
def accepted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.accepted_violations(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"])


@query("""
    WITH k AS (SELECT DISTINCT user_id AS "key" FROM events),
    d AS (SELECT CAST(g AS DATE) AS "day" FROM generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(g)),
    c AS (SELECT user_id AS "key", CAST(ts AS DATE) AS "day", count(*) AS n FROM events GROUP BY 1, 2)
    SELECT k."key", CAST(d."day" AS VARCHAR) AS "day", coalesce(c.n, 0) AS n
    FROM k CROSS JOIN d LEFT JOIN c ON c."key" = k."key" AND c."day" = d."day" WHERE coalesce(c.n, 0) < 2
""")
def group_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _day_as_text(groups.group_completeness(events, "user_id", "ts", 2, "2024-01-01", "2024-01-30"))


@query("""
    SELECT user_id AS "key", CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day FROM events GROUP BY 1
    HAVING max(CAST(ts AS DATE)) < (SELECT max(CAST(ts AS DATE)) FROM events)
""")
def coverage_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = groups.coverage_drop(table(spark, sf_dir, "events"), "user_id", "ts")
    return dropped.withColumn("last_day", F.col("last_day").cast("string"))


@query("""
    WITH s AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
    t AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CAST(coalesce(s.d, t.d) AS VARCHAR) AS "day", coalesce(s.n, 0) AS source_rows,
           coalesce(t.n, 0) AS target_rows, coalesce(t.n, 0) - coalesce(s.n, 0) AS difference
    FROM s FULL OUTER JOIN t ON s.d = t.d
""")
def reconcile_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(reconcile.reconcile_by_day(
        table(spark, sf_dir, "orders"), "o_orderdate", table(spark, sf_dir, "lineitem"), "l_shipdate"
    ))


@query("""
    SELECT o_orderkey, 'target' AS missing_in FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL
    SELECT DISTINCT l_orderkey, 'source' FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey
""")
def reconcile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile_keys(
        table(spark, sf_dir, "orders"), ["o_orderkey"], table(spark, sf_dir, "lineitem"), ["l_orderkey"]
    )


# The published aggregate has defects: totals that are off, keys left out, keys nobody has readings for.
_PUBLISHED_SQL = """published AS (
    SELECT "key" + CASE WHEN peak < 2 THEN 1000000000 ELSE 0 END AS "key", "day",
           daily_total + CASE WHEN peak BETWEEN 50 AND 60 THEN 1.5 ELSE 0 END AS daily_total, average_reading, peak
    FROM gold WHERE peak <= 150)"""


@query(f"""
    WITH {SILVER_SQL}, {GOLD_SQL}, {_PUBLISHED_SQL},
    c AS (SELECT coalesce(g."key", p."key") AS "key", coalesce(g."day", p."day") AS "day",
                 g.daily_total AS dt, p.daily_total AS pt, g.average_reading AS da, p.average_reading AS pa,
                 g.peak AS dp, p.peak AS pp,
                 CASE WHEN g."key" IS NULL THEN 'only_published' WHEN p."key" IS NULL THEN 'only_detail'
                      WHEN abs(g.daily_total - p.daily_total) > 0.005 OR abs(g.average_reading - p.average_reading) > 0.005
                           OR abs(g.peak - p.peak) > 0.005 THEN 'differs' ELSE 'match' END AS status
          FROM gold g FULL OUTER JOIN published p ON g."key" = p."key" AND g."day" = p."day")
    SELECT "key", CAST("day" AS VARCHAR) AS "day", status,
           coalesce(round(dt, 2), -1) AS derived_total, coalesce(round(pt, 2), -1) AS published_total,
           coalesce(round(da, 8), -1) AS derived_average, coalesce(round(pa, 8), -1) AS published_average,
           coalesce(dp, -1) AS derived_peak, coalesce(pp, -1) AS published_peak
    FROM c WHERE status <> 'match'
""")
def agg_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = silver(spark, sf_dir)
    key, peak = F.col("key"), F.col("peak")
    published = (
        pipeline.peak_day(readings, key="user_id", ts="ts", reading="value")
        .where(peak <= 150)
        .withColumn("daily_total", F.col("daily_total") + F.when(peak.between(50, 60), 1.5).otherwise(0))
        .withColumn("key", key + F.when(peak < 2, 1_000_000_000).otherwise(0))
    )
    detail = readings.select(F.col("user_id").alias("key"), F.col("collection_date").alias("day"), "value")
    compared = reconcile.aggregate_sanity(
        detail, published, ["key", "day"], "value",
        {"total": "daily_total", "average": "average_reading", "peak": "peak"},
    )
    digits = {"total": 2, "average": 8, "peak": 2}
    shown = [
        F.coalesce(F.round(f"{side}_{part}", n), F.lit(-1.0)).alias(f"{side}_{part}")
        for part, n in digits.items() for side in ("derived", "published")
    ]
    return _day_as_text(compared).select("key", "day", "status", *shown)


@query(f"""
    WITH {SILVER_SQL}, {GOLD_SQL},
    large AS (SELECT "key", "day", daily_total * 1000000000000 AS daily_total, peak FROM gold),
    published AS (SELECT * FROM large WHERE peak > 2 UNION ALL SELECT "key", "day", 3 * daily_total, peak FROM large WHERE peak BETWEEN 20 AND 30),
    p AS (SELECT "key", "day", max(daily_total) AS pt, count(*) AS n FROM published GROUP BY 1, 2)
    SELECT coalesce(g."key", p."key") AS "key", CAST(coalesce(g."day", p."day") AS VARCHAR) AS "day",
           CASE WHEN p.n > 1 THEN 'duplicate_published' WHEN p.n IS NULL THEN 'only_detail' END AS status
    FROM large g FULL OUTER JOIN p ON g."key" = p."key" AND g."day" = p."day" WHERE p.n > 1 OR p.n IS NULL
""")
def agg_sanity_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of 10^12 and more, some published twice: no difference but in how often a key is published."""
    readings = silver(spark, sf_dir)
    scaled = readings.withColumn("value", F.col("value") * 1e12)
    large = pipeline.peak_day(readings, key="user_id", ts="ts", reading="value").withColumn("daily_total", F.col("daily_total") * 1e12)
    twice = large.where("peak BETWEEN 20 AND 30").withColumn("daily_total", 3 * F.col("daily_total"))
    detail = scaled.select(F.col("user_id").alias("key"), F.col("collection_date").alias("day"), "value")
    compared = reconcile.aggregate_sanity(
        detail, large.where("peak > 2").unionByName(twice), ["key", "day"], "value", {"total": "daily_total"},
    )
    return _day_as_text(compared).select("key", "day", "status")


@query("""
    WITH k AS (SELECT DISTINCT user_id AS "key" FROM events),
    d AS (SELECT CAST(g AS DATE) AS "day" FROM generate_series(DATE '2024-01-03', DATE '2024-01-05', INTERVAL 1 DAY) t(g)),
    c AS (SELECT user_id AS "key", CAST(ts AS DATE) AS "day", count(*) AS n FROM events GROUP BY 1, 2)
    SELECT k."key", 3 AS days, CAST(count(*) AS INT) AS missing_days, CAST(min(d."day") AS VARCHAR) AS first_missing,
           CAST(max(d."day") AS VARCHAR) AS last_missing
    FROM k CROSS JOIN d LEFT JOIN c ON c."key" = k."key" AND c."day" = d."day" WHERE coalesce(c.n, 0) < 1 GROUP BY 1
""")
def completeness_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of a longer table: keys that have rows only outside them are reported with all days missing."""
    found = groups.completeness_by_key(table(spark, sf_dir, "events"), "user_id", "ts", 1, "2024-01-03", "2024-01-05")
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_missing", "last_missing")})
