"""From evidence to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds in the unit of ``observed``: minutes of lag, share of deviation, rows or groups found.
# 24 hours and 5 percent are the published rules.
DEFAULT_BANDS = (
    ("freshness", 24.0 * 60, 48.0 * 60, "minutes behind", "check the upstream load"),
    ("rows_by_day", 0.05, 0.20, "largest deviation from the median day", "compare the days with their sources"),
    ("nulls", 0.0, 0.0, "null rows", "trace the rows without a value"),
    ("range", 0.0, 0.0, "rows out of range", "trace the rows out of range"),
    ("accepted", 0.0, 0.0, "rows with an unknown value", "extend the allowed values or fix the source"),
    ("duplicate_grain", 0.0, 0.0, "duplicate grain values", "remove duplicates or correct the grain"),
    ("schema", 0.0, 0.0, "columns that differ", "agree on the columns with the producer"),
    ("completeness", 0.0, 0.0, "keys with missing days", "load the missing days again"),
    ("coverage", 0.0, 0.0, "keys that stopped", "ask the sources that stopped"),
    ("cutoff", 0.0, 0.0, "days short after their cutoff", "load the short days again"),
    ("reconcile_days", 0.0, 0.0, "days that differ", "compare the days on both sides"),
    ("reconcile_keys", 0.0, 0.0, "keys on one side only", "compare the keys on both sides"),
    ("aggregate", 0.0, 0.0, "aggregates that differ", "derive the aggregates again"),
)


def bands(spark: SparkSession, rows: tuple[tuple, ...] = DEFAULT_BANDS) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "kind string, pass_to double, warn_to double, measured string, action string"
    )


def findings(evidence: DataFrame, thresholds: DataFrame, digits: int = 6) -> DataFrame:
    """A finding per check.

    A check that could not run warns.  One that ran passes if its kind has no
    bounds; if it observed nothing it fails for freshness (an empty table) and
    warns otherwise.
    """
    observed, ran = F.col("observed"), F.col("status") == "ok"
    severity = (
        F.when(~ran, "warn")
        .when(F.col("pass_to").isNull(), "pass")
        .when(observed.isNull() & (F.col("kind") == "freshness"), "fail")
        .when(observed.isNull(), "warn")
        .when(observed <= F.col("pass_to"), "pass")
        .when(observed <= F.col("warn_to"), "warn")
        .otherwise("fail")
    )
    value = F.coalesce(F.format_string(f"%.{digits}f", observed), F.lit("nothing"))
    text = F.when(
        ran & F.col("pass_to").isNull(), F.concat(F.col("kind"), F.lit(": no bounds"))
    ).when(
        ran, F.concat(F.col("measured"), F.lit(": "), value, F.lit(" (passes up to "),
                      F.format_string(f"%.{digits}f", F.col("pass_to")), F.lit(")"))
    ).otherwise(F.concat(F.lit("not run: "), F.col("status")))
    return evidence.join(thresholds, "kind", "left").select(
        F.concat(F.col("check_name"), F.lit(": "), severity).alias("title"),
        severity.alias("severity"),
        text.alias("evidence"),
        F.when(severity == "pass", "no action").otherwise(F.coalesce("action", F.lit("see why the check did not run"))).alias("recommended_action"),
        F.col("check_id").alias("related_check"),
        F.col("target_table").alias("related_table"),
    )
