"""Suggesting checks from what a profile shows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import count_all
from ..operators.profile import union_all

# Checks asked for per run, and what a short run is cut to.
TARGET_CHECKS = 8
SHORT_RUN, SHORT_PER_TABLE = 6, 2

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Share of a text column's values that have to read as moments for it to count as a time column.
READABLE = 0.95
_DISCRETE = ("tinyint", "smallint", "int", "bigint", "string")


def _numeric(kind: str) -> bool:
    return kind in _NUMERIC or kind.startswith("decimal")


def column_profile(tables: Mapping[str, DataFrame], sketch_size: int = 14) -> DataFrame:
    """(table_id, ordinal, column, type, rows, nulls, distinct, lowest, moments), one scan per table.

    ``distinct`` is a sketch estimate for whole numbers and texts, good to one
    percent and exact for few values: exact distinct counts of every column
    would multiply the rows by the number of columns before the shuffle.  ``moments`` are the values of a text
    column that read as a time.
    """
    frames = []
    for table_id, df in tables.items():
        aggregates, entries = [count_all().alias("rows")], []
        for i, f in enumerate(df.schema.fields):
            kind = f.dataType.simpleString()
            aggregates.append(F.count(f.name).alias(f"v{i}"))
            if kind in _DISCRETE:
                value = F.col(f.name) if kind in ("bigint", "string") else F.col(f.name).cast("int")
                aggregates.append(F.hll_sketch_estimate(F.hll_sketch_agg(value, sketch_size)).alias(f"d{i}"))
            if kind == "string":
                aggregates.append(F.count(F.col(f.name).try_cast("timestamp_ntz")).alias(f"t{i}"))
            if _numeric(kind):
                aggregates.append(F.min(f.name).cast("double").alias(f"l{i}"))
            entries.append(
                F.struct(
                    F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(kind).alias("type"),
                    (F.col("rows") - F.col(f"v{i}")).alias("nulls"),
                    (F.col(f"d{i}") if kind in _DISCRETE else F.lit(None)).cast("bigint").alias("distinct"),
                    (F.col(f"l{i}") if _numeric(kind) else F.lit(None)).cast("double").alias("lowest"),
                    (F.col(f"t{i}") if kind == "string" else F.lit(None)).cast("bigint").alias("moments"),
                )
            )
        frames.append(
            df.agg(*aggregates).select(F.lit(table_id).alias("table_id"), "rows", F.inline(F.array(*entries)))
        )
    return union_all(frames)


def suggest_checks(
    profile: DataFrame, per_table: int | None = None, limit: int | None = None, few_values: int = 20,
    nearly_all: float = 0.97,
) -> DataFrame:
    """Check specs from a column profile, most useful first.

    The best time column gives freshness and rows per day: the first timestamp, else the first date, else the first text
    whose values read as moments.  A discrete column
    with nearly as many values as rows gives a duplicate check, one with few values
    an accepted-values check, a number that is never negative and no key a range check,
    and a column without nulls a null check.  Only columns of the profile can
    appear.  The profile has a row per column, so its windows are small.
    """
    values = F.col("rows") - F.col("nulls")
    kind_of_time = (
        F.when(F.col("type").rlike("^timestamp"), 0).when(F.col("type") == "date", 1)
        .when((F.col("type") == "string") & (values > 0) & (F.col("moments") >= READABLE * values), 2)
    )
    is_time = kind_of_time.isNotNull()
    times = W.partitionBy("table_id", is_time).orderBy(kind_of_time, "ordinal")
    profile = profile.withColumn("_first_time", is_time & (F.row_number().over(times) == 1))
    first_time = F.col("_first_time")
    has_rows = F.col("rows") > 0
    unique = F.col("type").isin(*_DISCRETE) & has_rows & (F.col("distinct") >= F.col("rows") * nearly_all)
    few = F.col("type").isin(*_DISCRETE) & has_rows & (F.col("distinct") <= few_values) & ~unique
    # Backquotes keep any column name valid; the table id is quoted part by part.
    name = F.concat(F.lit("`"), F.regexp_replace("column", "`", "``"), F.lit("`"))
    table = F.concat(F.lit("`"), F.regexp_replace("table_id", r"\.", "`.`"), F.lit("`"))

    def rule(when, rank: int, kind: str, category: str, outcome: str, *sql: object):
        parts = [p if not isinstance(p, str) else F.lit(p) for p in sql]
        return F.when(
            when,
            F.struct(
                F.lit(rank).alias("priority"), F.lit(kind).alias("kind"), F.lit(category).alias("category"),
                F.lit(outcome).alias("expected_outcome"), F.concat(*parts).alias("sql"),
            ),
        )

    rules = F.array(
        rule(first_time, 1, "freshness", "freshness", "latest within last 24 hours",
             "SELECT MAX(", name, ") AS latest FROM ", table),
        rule(first_time, 2, "rows_by_day", "row_count", "stable counts day over day",
             "SELECT CAST(", name, " AS DATE) AS d, COUNT(*) AS c FROM ", table,
             " GROUP BY 1 ORDER BY 1 DESC LIMIT 14"),
        rule(unique, 3, "duplicate_grain", "duplicate_grain", "no value occurs twice",
             "SELECT ", name, ", COUNT(*) AS c FROM ", table, " GROUP BY 1 HAVING COUNT(*) > 1 LIMIT 10"),
        rule(few, 4, "distribution", "business_rule", "only known values",
             "SELECT ", name, ", COUNT(*) AS c FROM ", table, " GROUP BY 1 ORDER BY 2 DESC LIMIT 10"),
        rule((F.col("lowest") >= 0) & ~unique, 5, "range", "business_rule",
             "never negative", "SELECT COUNT(*) AS outside FROM ", table, " WHERE ", name, " < 0"),
        rule((F.col("nulls") == 0) & has_rows, 6, "nulls", "null_check", "no nulls",
             "SELECT COUNT(*) AS null_rows FROM ", table, " WHERE ", name, " IS NULL"),
    )
    found = profile.select(
        "table_id", "ordinal", "column", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("_rule")
    ).select("table_id", "ordinal", "column", "_rule.*")
    in_table = W.partitionBy("table_id").orderBy("priority", "ordinal")
    ranked = found.withColumn("table_rank", F.row_number().over(in_table))
    if per_table is not None:
        ranked = ranked.where(F.col("table_rank") <= per_table)
    checks = ranked.withColumn("id", F.concat_ws("_", F.lit("chk"), "kind", "table_id", "column"))
    if limit is not None:
        checks = checks.orderBy("table_rank", "table_id").limit(limit)
    return checks
