"""Profiles, metadata and the detail-to-aggregate pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import moment
from ..operators import profile
from ..operators.profile import RangeRule, union_all
from ..plans import guard, pipeline
from ..sources import catalog
from . import query, table

AS_OF = "2024-01-31 00:00:00"
TIME_CANDIDATES = ("data_collection_log_timestamp", "ts", "o_orderdate", "l_shipdate")

# The columns of the benchmark tables and their types in Spark.
COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                 "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS row_count FROM {t}" for t in COLUMNS))
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(profile.row_count(table(spark, sf_dir, t), t) for t in COLUMNS)


@query("""
    SELECT 'events' AS table_id, 'ts' AS ts_column, min(ts) AS min_ts, max(ts) AS max_ts FROM events
    UNION ALL SELECT 'orders', 'o_orderdate', min(o_orderdate), max(o_orderdate) FROM orders
    UNION ALL SELECT 'lineitem', 'l_shipdate', min(l_shipdate), max(l_shipdate) FROM lineitem
""")
def ts_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = (
        profile.timestamp_bounds(table(spark, sf_dir, t), t, TIME_CANDIDATES)
        for t in ("events", "orders", "lineitem", "customer")
    )
    return union_all(f for f in found if f is not None)


_LAG = "datesub('minute', max({c}), TIMESTAMP '" + AS_OF + "')"
_FRESH = (
    "SELECT '{t}' AS table_id, max({c}) AS latest, " + _LAG + " AS lag_minutes,"
    " CASE WHEN " + _LAG + " <= 1440 THEN 'pass' WHEN " + _LAG + " <= 2880 THEN 'warn' ELSE 'fail' END AS severity"
    " FROM {t}"
)


@query(" UNION ALL ".join(
    _FRESH.format(t=t, c=c) for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
))
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(
        profile.freshness(table(spark, sf_dir, t), t, c, AS_OF)
        for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    )


# The tables have no nulls, so the null checks look at a view of events that has.
GAPPY_SQL = """gappy AS (
    SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
           CASE WHEN value > 100 THEN NULL ELSE value END AS value, props FROM events)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .withColumn("event_type", F.nullif("event_type", F.lit("error")))
        .withColumn("value", F.when(F.col("value") <= 100, F.col("value")))
    )


@query("WITH " + GAPPY_SQL + " UNION ALL ".join(
    f"""SELECT 'events' AS table_id, count(*) AS "rows", '{c}' AS "column", count(*) - count({c}) AS nulls,
        round((count(*) - count({c}))::DOUBLE / count(*), 6) AS null_share FROM gappy """
    for c in COLUMNS["events"]
))
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_profile(gappy(spark, sf_dir), "events")


_EXPECTED_NULLS = (("event_id", False), ("event_type", False), ("value", True), ("props", False), ("channel", False))


@query("WITH " + GAPPY_SQL + """
    SELECT 'events' AS table_id, c AS "column", coalesce(n, -1) AS nulls,
           CASE WHEN n IS NULL THEN 'skipped' WHEN n = 0 THEN 'pass' ELSE 'fail' END AS severity
    FROM (SELECT 'event_id' AS c, count(*) - count(event_id) AS n FROM gappy
          UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM gappy
          UNION ALL SELECT 'props', count(*) - count(props) FROM gappy
          UNION ALL SELECT 'channel', NULL)
""")
def nullable_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame(
        [("events", c, e) for c, e in _EXPECTED_NULLS], "table_id string, column string, nullable_expected boolean"
    )
    seen = profile.nullable_expected(profile.null_profile(gappy(spark, sf_dir), "events"), expected)
    return seen.withColumn("nulls", F.coalesce("nulls", F.lit(-1).cast("bigint")))


RULES = {
    "lineitem": (
        RangeRule("quantity", "l_quantity", 1, 45),
        RangeRule("discount", "l_discount", 0, 0.08),
        RangeRule("not negative", "l_tax", 0, None),
    ),
    "events": (RangeRule("peak", "value", 0, 200),),
}


@query("""
    SELECT 'lineitem' AS table_id, count(*) AS "rows", 'quantity' AS rule, 'l_quantity' AS "column",
           count(*) FILTER (l_quantity < 1 OR l_quantity > 45) AS violations,
           CASE WHEN count(*) FILTER (l_quantity < 1 OR l_quantity > 45) = 0 THEN 'pass' ELSE 'fail' END AS severity
    FROM lineitem
    UNION ALL
    SELECT 'lineitem', count(*), 'discount', 'l_discount',
           count(*) FILTER (l_discount < 0 OR l_discount > CAST(0.08 AS DOUBLE)),
           CASE WHEN count(*) FILTER (l_discount < 0 OR l_discount > CAST(0.08 AS DOUBLE)) = 0
                THEN 'pass' ELSE 'fail' END FROM lineitem
    UNION ALL
    SELECT 'lineitem', count(*), 'not negative', 'l_tax', count(*) FILTER (l_tax < 0),
           CASE WHEN count(*) FILTER (l_tax < 0) = 0 THEN 'pass' ELSE 'fail' END FROM lineitem
    UNION ALL
    SELECT 'events', count(*), 'peak', 'value', count(*) FILTER (value < 0 OR value > 200),
           CASE WHEN count(*) FILTER (value < 0 OR value > 200) = 0 THEN 'pass' ELSE 'fail' END FROM events
""")
def range_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(profile.range_rules(table(spark, sf_dir, t), t, rules) for t, rules in RULES.items())


_NEVER = "TIMESTAMP '1970-01-01 00:00:00'"


@query(
    f"""SELECT 'lineitem' AS table_id, '' AS "column", 'rows' AS metric, count(*) AS number, {_NEVER} AS "at"
       FROM lineitem
       UNION ALL SELECT 'lineitem', 'l_shipdate', 'min', -1, min(l_shipdate) FROM lineitem
       UNION ALL SELECT 'lineitem', 'l_shipdate', 'max', -1, max(l_shipdate) FROM lineitem"""
    + "".join(
        f" UNION ALL SELECT 'lineitem', '{c}', 'nulls', count(*) - count({c}), {_NEVER} FROM lineitem"
        for c in COLUMNS["lineitem"]
    )
    + f""" UNION ALL SELECT 'lineitem', 'l_quantity', 'outside:quantity',
             count(*) FILTER (l_quantity < 1 OR l_quantity > 45), {_NEVER} FROM lineitem
       UNION ALL SELECT 'lineitem', 'l_discount', 'outside:discount',
             count(*) FILTER (l_discount < 0 OR l_discount > CAST(0.08 AS DOUBLE)), {_NEVER} FROM lineitem
       UNION ALL SELECT 'lineitem', 'l_tax', 'outside:not negative', count(*) FILTER (l_tax < 0), {_NEVER}
       FROM lineitem"""
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All single-value metrics of a table, fused into one scan."""
    found = profile.table_profile(
        table(spark, sf_dir, "lineitem"), "lineitem", timestamps=TIME_CANDIDATES, rules=RULES["lineitem"]
    )
    return found.na.fill("").na.fill(-1).withColumn("at", F.coalesce("at", moment("1970-01-01 00:00:00")))


@query(" UNION ALL ".join(
    f"""SELECT '{t}' AS table_id, {i} AS ordinal, '{c}' AS "column", '{kind}' AS type, false AS is_partition,
        count(*) AS "rows", count(*) - count({c}) AS nulls FROM {t}"""
    for t, columns in COLUMNS.items() for i, (c, kind) in enumerate(columns.items())
))
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of every table together with what its columns hold."""
    tables = {t: table(spark, sf_dir, t) for t in COLUMNS}
    listed = catalog.columns_of(spark, tables)
    return listed.join(profile.column_counts(tables), ["table_id", "column"], "left").select(
        "table_id", "ordinal", "column", "type", "is_partition", "rows", "nulls"
    )


# What is expected of events: one column renamed, one of another type, one unheard of.
_EXPECTED = (
    ("events", "event_id", "bigint"), ("events", "ts", "timestamp_ntz"), ("events", "user_id", "int"),
    ("events", "event_kind", "string"), ("events", "value", "double"), ("events", "props", "string"),
)


@query("""
    WITH expected(table_id, "column", expected_type) AS (VALUES
        ('events', 'event_id', 'bigint'), ('events', 'ts', 'timestamp_ntz'), ('events', 'user_id', 'int'),
        ('events', 'event_kind', 'string'), ('events', 'value', 'double'), ('events', 'props', 'string')),
    actual AS (
        SELECT 'events' AS table_id, 'event_id' AS "column", 'bigint' AS actual_type, count(event_id) AS n FROM events
        UNION ALL SELECT 'events', 'ts', 'timestamp_ntz', count(ts) FROM events
        UNION ALL SELECT 'events', 'user_id', 'bigint', count(user_id) FROM events
        UNION ALL SELECT 'events', 'event_type', 'string', count(event_type) FROM events
        UNION ALL SELECT 'events', 'value', 'double', count(value) FROM events
        UNION ALL SELECT 'events', 'props', 'string', count(props) FROM events)
    SELECT table_id, "column", coalesce(expected_type, '') AS expected_type, coalesce(actual_type, '') AS actual_type,
           CASE WHEN actual_type IS NULL THEN 'missing' WHEN expected_type IS NULL THEN 'extra'
                WHEN actual_type <> expected_type THEN 'type_changed' ELSE 'match' END AS change,
           coalesce(n, 0) AS values_seen
    FROM expected FULL OUTER JOIN actual USING (table_id, "column")
""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against actual columns, with the number of values behind each actual one."""
    events = table(spark, sf_dir, "events")
    expected = spark.createDataFrame(
        [(*row, False) for row in _EXPECTED], "table_id string, column string, type string, is_partition boolean"
    )
    counts = profile.null_profile(events, "events").select(
        "table_id", "column", (F.col("rows") - F.col("nulls")).alias("values_seen")
    )
    changes = catalog.schema_diff(expected, catalog.columns_of(spark, {"events": events}))
    return changes.join(counts, ["table_id", "column"], "left").na.fill("").na.fill(0)


TABLE_ID_SQL = """CASE event_id % 3 WHEN 0 THEN concat('tbl', user_id)
    WHEN 1 THEN concat(event_type, '.tbl', user_id) ELSE concat('cat.', event_type, '.tbl', user_id) END"""


@query(f"""
    WITH ids AS (SELECT event_id, {TABLE_ID_SQL} AS table_id FROM events)
    SELECT event_id, table_id,
           CASE WHEN event_id % 3 = 2 THEN split_part(table_id, '.', 1) ELSE '' END AS catalog,
           CASE event_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN split_part(table_id, '.', 1)
                ELSE split_part(table_id, '.', 2) END AS database,
           split_part(table_id, '.', -1) AS name,
           CASE WHEN contains(table_id, '.') THEN split_part(table_id, '.', 1) ELSE 'default' END AS legacy_db,
           CASE WHEN contains(table_id, '.') THEN substr(table_id, strpos(table_id, '.') + 1)
                ELSE table_id END AS legacy_name
    FROM ids
""")
def resolve_table_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("event_id", F.expr(TABLE_ID_SQL).alias("table_id"))
    return catalog.resolve_ids(ids).na.fill("", ["catalog"])


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority
    FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)
""")
def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return guard.bounded_sample(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("""
    SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS "at", CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           count(*) OVER () AS total_rows, count(*) OVER () > 25 AS truncated
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""")
def counted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows with the number of all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    found = guard.counted_sample(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    # At most 25 rows: one window over all of them numbers them.
    place = F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")) - 1
    return found.select(place.cast("long").alias("at"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "total_rows", "truncated")


# Meter readings: a reading per event, from 0 to 4 active devices.
SILVER_SQL = """silver AS (
    SELECT event_id, user_id, ts, value, event_id % 5 AS devices, hour(ts) AS hour_of_day, minute(ts) AS minute_of_hour,
           hour(ts) * 2 + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END AS half_hour_slot,
           dayofweek(ts) + 1 AS day_of_week, dayofweek(ts) IN (0, 6) AS is_weekend,
           concat(user_id, '_', event_type) AS composite_key, value / (event_id % 5) AS reading_per_device,
           CAST(ts AS DATE) AS collection_date
    FROM events WHERE ts IS NOT NULL AND event_id % 5 > 0)"""
GOLD_SQL = """gold AS (
    SELECT user_id AS "key", CAST(ts AS DATE) AS "day", sum(value) AS daily_total, avg(value) AS average_reading,
           max(value) AS peak, min(ts) FILTER (value = top) AS peak_timestamp
    FROM (SELECT *, max(value) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS top FROM silver)
    GROUP BY 1, 2)"""


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn("devices", F.col("event_id") % 5)
    return pipeline.clean_half_hourly(
        raw, ts="ts", reading="value", devices="devices", key_parts=("user_id", "event_type")
    )


@query(f"""
    WITH {SILVER_SQL}
    SELECT event_id, CAST(hour_of_day AS INT) AS hour_of_day, CAST(minute_of_hour AS INT) AS minute_of_hour,
           CAST(half_hour_slot AS INT) AS half_hour_slot, CAST(day_of_week AS INT) AS day_of_week, is_weekend,
           composite_key, round(reading_per_device, 6) AS reading_per_device,
           CAST(collection_date AS VARCHAR) AS collection_date
    FROM silver
""")
def silver_half_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver(spark, sf_dir).select(
        "event_id", "hour_of_day", "minute_of_hour", "half_hour_slot", "day_of_week", "is_weekend", "composite_key",
        F.round("reading_per_device", 6).alias("reading_per_device"),
        F.col("collection_date").cast("string").alias("collection_date"),
    )


@query(f"""
    WITH {SILVER_SQL}, {GOLD_SQL}
    SELECT "key", CAST("day" AS VARCHAR) AS "day", round(daily_total, 2) AS daily_total,
           round(average_reading, 8) AS average_reading, peak, peak_timestamp FROM gold
""")
def gold_peak_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.peak_day(silver(spark, sf_dir), key="user_id", ts="ts", reading="value").select(
        "key", F.col("day").cast("string").alias("day"), F.round("daily_total", 2).alias("daily_total"),
        F.round("average_reading", 8).alias("average_reading"), "peak", "peak_timestamp",
    )


@query(f"""
    WITH {SILVER_SQL}
    SELECT user_id AS "key", CAST(half_hour_slot AS INT) AS half_hour_slot,
           round(avg(value), 8) AS average_reading, count(*) AS readings
    FROM silver GROUP BY 1, 2
""")
def load_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.load_profile(silver(spark, sf_dir), key="user_id", reading="value").withColumn(
        "average_reading", F.round("average_reading", 8)
    )
