"""Table profiles: all single-value metrics of a table from one scan.

Each metric is an entry (column, metric, aggregate).  ``measure`` puts any
number of entries into one aggregation and turns the single result row into
long form, so forty metrics cost one pass over the needed columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import banded, count_all, minutes_between, moment, share, zero_is_pass


@dataclass(frozen=True)
class Metric:
    """One aggregate over a whole table."""

    column: str | None
    metric: str
    value: Column


@dataclass(frozen=True)
class RangeRule:
    """Values of ``column`` must lie in [low, high]; either end may be open."""

    name: str
    column: str
    low: float | None = None
    high: float | None = None

    def violated(self, value: Column | None = None) -> Column:
        """Whether ``value``, else the column, lies outside."""
        value = F.col(self.column) if value is None else value
        tests = []
        if self.low is not None:
            tests.append(value < F.lit(self.low))
        if self.high is not None:
            tests.append(value > F.lit(self.high))
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def measure(df: DataFrame, table_id: str, metrics: Sequence[Metric]) -> DataFrame:
    """(table_id, column, metric, number, at): counts in ``number``, moments in ``at``."""
    names = [f"m{i}" for i in range(len(metrics))]
    row = df.agg(*[m.value.alias(n) for m, n in zip(metrics, names)])
    entries = []
    for m, n in zip(metrics, names):
        is_time = isinstance(row.schema[n].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        entries.append(
            F.struct(
                F.lit(m.column).cast("string").alias("column"),
                F.lit(m.metric).alias("metric"),
                (F.lit(None) if is_time else F.col(n)).cast("bigint").alias("number"),
                (F.col(n) if is_time else F.lit(None)).cast("timestamp_ntz").alias("at"),
            )
        )
    return row.select(F.lit(table_id).alias("table_id"), F.inline(F.array(*entries)))


def null_metrics(columns: Iterable[str]) -> list[Metric]:
    return [Metric(c, "nulls", F.count_if(F.col(c).isNull())) for c in columns]


def range_metrics(rules: Iterable[RangeRule]) -> list[Metric]:
    return [Metric(r.column, f"outside:{r.name}", F.count_if(r.violated())) for r in rules]


def first_timestamp(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate the table has, in the caller's order."""
    return next((c for c in candidates if c in df.columns), None)


def moment_of(df: DataFrame, name: str) -> Column:
    """A time column as it is; a text as the moment it can be read as, else null."""
    return F.col(name).try_cast("timestamp_ntz") if df.schema[name].dataType.typeName() == "string" else F.col(name)


def bounds_metrics(df: DataFrame, candidates: Sequence[str]) -> list[Metric]:
    found = first_timestamp(df, candidates)
    if found is None:
        return []
    at = moment_of(df, found)
    return [Metric(found, "min", F.min(at)), Metric(found, "max", F.max(at))]


def table_profile(
    df: DataFrame, table_id: str, *, timestamps: Sequence[str] = (), rules: Sequence[RangeRule] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Row count, time bounds, nulls of every column and range violations, in one scan."""
    return measure(
        df, table_id,
        [Metric(None, "rows", count_all())]
        + bounds_metrics(df, timestamps)
        + null_metrics(df.columns if columns is None else columns)
        + range_metrics(rules),
    )


def row_count(df: DataFrame, table_id: str) -> DataFrame:
    return df.agg(count_all().alias("row_count")).select(F.lit(table_id).alias("table_id"), "row_count")


def timestamp_bounds(df: DataFrame, table_id: str, candidates: Sequence[str]) -> DataFrame | None:
    """Bounds of the first candidate present; None when the table has none of them."""
    found = first_timestamp(df, candidates)
    if found is None:
        return None
    at = moment_of(df, found)
    return df.agg(
        F.min(at).cast("timestamp_ntz").alias("min_ts"), F.max(at).cast("timestamp_ntz").alias("max_ts")
    ).select(F.lit(table_id).alias("table_id"), F.lit(found).alias("ts_column"), "min_ts", "max_ts")


def freshness(
    df: DataFrame, table_id: str, ts: str, as_of: str, pass_hours: int = 24, warn_hours: int = 48
) -> DataFrame:
    """Latest timestamp and its lag behind ``as_of`` in whole minutes, with a verdict."""
    latest = df.agg(F.max(moment_of(df, ts)).cast("timestamp_ntz").alias("latest"))
    lag = minutes_between("latest", moment(as_of))
    verdict = F.when(F.col("latest").isNull(), "fail").otherwise(
        banded("lag_minutes", pass_hours * 60, warn_hours * 60)
    )
    return (
        latest.withColumn("lag_minutes", lag)
        .select(F.lit(table_id).alias("table_id"), "latest", "lag_minutes", verdict.alias("severity"))
    )


def null_profile(df: DataFrame, table_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and share of every column, one scan."""
    names = list(df.columns if columns is None else columns)
    row = df.agg(count_all().alias("rows"), *[F.count(c).alias(f"v{i}") for i, c in enumerate(names)])
    entries = [
        F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"v{i}")).alias("nulls"))
        for i, c in enumerate(names)
    ]
    return row.select(F.lit(table_id).alias("table_id"), "rows", F.inline(F.array(*entries))).withColumn(
        "null_share", share("nulls", "rows")
    )


def range_rules(df: DataFrame, table_id: str, rules: Sequence[RangeRule]) -> DataFrame:
    """Violations of every rule, one scan."""
    row = df.agg(count_all().alias("rows"), *[F.count_if(r.violated()).alias(f"v{i}") for i, r in enumerate(rules)])
    entries = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"), F.col(f"v{i}").alias("violations"))
        for i, r in enumerate(rules)
    ]
    return row.select(F.lit(table_id).alias("table_id"), "rows", F.inline(F.array(*entries))).withColumn(
        "severity", zero_is_pass("violations")
    )


def nullable_expected(profile: DataFrame, expected: DataFrame) -> DataFrame:
    """Nulls in columns that are declared as never null.

    ``profile`` is the output of :func:`null_profile`, ``expected`` has
    (table_id, column, nullable_expected); both have one row per column.
    """
    strict = expected.where(~F.col("nullable_expected")).select("table_id", "column")
    return strict.join(profile, ["table_id", "column"], "left").select(
        "table_id", "column", "nulls",
        F.when(F.col("nulls").isNull(), "skipped").otherwise(zero_is_pass("nulls")).alias("severity"),
    )


def column_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Null profiles of several tables under each other."""
    return union_all(null_profile(df, table_id) for table_id, df in tables.items())
