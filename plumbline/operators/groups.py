"""Checks that group a table: counts per day, duplicates, values, completeness."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import banded, count_all, day, moment, share


#: Days that one long has bits for.
DAYS_A_WORD = 63


def rows_by_day(df: DataFrame, ts: str, days: int | None = 14, since: str | None = None) -> DataFrame:
    """(day, n) of the latest ``days`` days that have rows; every day with ``None``.

    ``since`` (a day) limits the scan, and skips partitions where the table is
    partitioned by ``ts``.
    """
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since).cast("date").cast("timestamp_ntz"))
    counts = df.groupBy(day(ts).alias("day")).agg(count_all().alias("n"))
    return counts if days is None else counts.orderBy(F.col("day").desc()).limit(days)


def median_deviation(counts: DataFrame, pass_share: float = 0.05, warn_share: float = 0.20) -> DataFrame:
    """Each day's distance from the median day.

    ``counts`` is (day, n) with a row per calendar day, so the window over all
    of it is bounded by the calendar and not by the table.
    """
    every_day = W.partitionBy(F.lit(1))
    apart = F.abs(F.col("n") - F.col("median_n"))
    return (
        counts.withColumn("median_n", F.median("n").over(every_day))
        .withColumn("deviation", share(apart, "median_n"))
        .withColumn("severity", banded("deviation", pass_share, warn_share))
    )


def day_over_day(counts: DataFrame) -> DataFrame:
    """Change against the day before among the days that have rows."""
    by_day = W.partitionBy(F.lit(1)).orderBy("day")
    return (
        counts.withColumn("previous_n", F.lag("n").over(by_day))
        .withColumn("change", F.col("n") - F.col("previous_n"))
        .withColumn("change_share", share("change", "previous_n"))
    )


def cutoff_status(
    counts: DataFrame, as_of: str, cutoff_hours: int = 9, tolerance: float = 0.05
) -> DataFrame:
    """A day may be short until ``cutoff_hours`` into the next day, not after.

    Short means more than ``tolerance`` below the median day.
    """
    due = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(1), F.lit(cutoff_hours))
    short = F.col("n") < F.col("median_n") * (1 - tolerance)
    return (
        counts.withColumn("median_n", F.median("n").over(W.partitionBy(F.lit(1))))
        .withColumn("complete_expected", moment(as_of) >= due)
        .withColumn(
            "severity",
            F.when(~short, "pass").when(F.col("complete_expected"), "fail").otherwise("warn"),
        )
    )


def duplicate_grain(df: DataFrame, grain: Sequence[str], limit: int | None = 10) -> DataFrame:
    """Grain values that occur more than once, most frequent first."""
    found = df.groupBy(*grain).agg(count_all().alias("n")).where(F.col("n") > 1)
    return found if limit is None else found.orderBy(F.col("n").desc(), *grain).limit(limit)


def grain_ratio(df: DataFrame, table_id: str, grain: Sequence[str]) -> DataFrame:
    """Is the grain unique?  Rows, distinct tuples and the share of surplus rows."""
    groups = df.groupBy(*grain).agg(count_all().alias("n"))
    totals = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), count_all().alias("groups"))
    return totals.select(
        F.lit(table_id).alias("table_id"), F.lit(",".join(grain)).alias("grain"), "rows", "groups",
        share(F.col("rows") - F.col("groups"), "rows").alias("duplicate_share"),
        (F.col("rows") == F.col("groups")).alias("is_unique"),
    )


def accepted_values(df: DataFrame, column: str, limit: int | None = 10) -> DataFrame:
    """Value distribution, most frequent first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(count_all().alias("n"))
    return counts if limit is None else counts.orderBy(F.col("n").desc(), "value").limit(limit)


def accepted_violations(df: DataFrame, column: str, allowed: Sequence[str] | DataFrame) -> DataFrame:
    """Non-null values outside the allowed set and how often they occur.

    A list becomes a filter that reaches the scan.  A DataFrame (one column)
    is anti-joined after the values have been counted, so the join sees every
    value once.
    """
    present = df.where(F.col(column).isNotNull())
    if not isinstance(allowed, DataFrame):
        return accepted_values(present.where(~F.col(column).isin(list(allowed))), column, None)
    known = allowed.toDF("value")
    return accepted_values(present, column, None).join(known, "value", "left_anti")


def group_completeness(
    df: DataFrame, key: str, ts: str, minimum: int, first_day: str, last_day: str
) -> DataFrame:
    """(key, day, n) with fewer than ``minimum`` rows, days without any row included.

    The day range is a parameter and also limits the scan.  Missing days are
    generated from the gaps between a key's days, so the full grid of keys and
    days is never joined.  A key counts when it has a row in the range.
    """
    start, end = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    # Compared as timestamps, not as days, so that the range reaches the scan.
    ranged = df.where(
        (F.col(ts) >= start.cast("timestamp_ntz"))
        & (F.col(ts) < F.date_add(end, 1).cast("timestamp_ntz"))
    )
    counts = ranged.groupBy(F.col(key).alias("key"), day(ts).alias("day")).agg(count_all().alias("n"))
    # A key has one row per day of the range here: the window is bounded.
    along = W.partitionBy("key").orderBy("day")
    gaps = counts.withColumn(
        "_until", F.date_sub(F.lead("day", 1).over(along), 1)
    ).withColumn("_first", F.lag("day").over(along).isNull())
    before = F.when(F.col("_first") & (F.col("day") > start), F.sequence(start, F.date_sub("day", 1)))
    after_end = F.coalesce(F.col("_until"), end)
    after = F.when(after_end > F.col("day"), F.sequence(F.date_add("day", 1), after_end))
    empty = F.array().cast("array<date>")
    missing = F.transform(
        F.concat(F.coalesce(before, empty), F.coalesce(after, empty)),
        lambda d: F.struct(d.alias("day"), F.lit(0).cast("bigint").alias("n")),
    )
    own = F.array(F.struct(F.col("day"), F.col("n")))
    return (
        gaps.select("key", F.inline(F.concat(own, missing)))
        .where(F.col("n") < minimum)
    )


def completeness_by_key(
    df: DataFrame, key: str, ts: str, minimum: int, first_day: str, last_day: str, *, keys: DataFrame | None = None
) -> DataFrame:
    """(key, days, missing_days, first_missing, last_missing): a row for every key short of ``minimum`` rows on some day of the range.

    Each key carries its days as bits, so it is one row however long the range is, and a key without any row in the range
    has all days missing.  ``keys`` (one column) are the keys that are expected; left out, those of the whole table
    are, at the price of its key column being read outside the range too.  A null key is a key; repeated keys count once.
    """
    start, end = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    inside = (F.col(ts) >= start.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(end, 1).cast("timestamp_ntz"))
    known = df.select(F.col(key).alias("key")) if keys is None else keys.toDF("key")
    # One grouping by key and day; a key that is only expected has the day null and no rows.
    both = df.where(inside).select(F.col(key).alias("key"), day(ts).alias("day"), F.lit(1).cast("long").alias("one")).unionAll(
        known.select("key", F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("one"))
    )
    counts = both.groupBy("key", "day").agg(F.sum("one").alias("n"), F.max(F.col("one") == 0).alias("expected"))
    # Bits of a long for 63 days each; the range is a parameter, so their number is known.
    total = (datetime.date.fromisoformat(last_day) - datetime.date.fromisoformat(first_day)).days + 1
    words = range(-(-total // DAYS_A_WORD))
    place = F.date_diff("day", start)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place % DAYS_A_WORD)
    full = F.col("n") >= minimum
    held = counts.groupBy("key").agg(
        *[F.bit_or(F.when(full & (F.floor(place / DAYS_A_WORD) == w), bit)).alias(f"w{w}") for w in words],
        F.max("expected").alias("expected"),
    )
    if keys is not None:
        held = held.where("expected")
    bits = F.array(*[F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")) for w in words])
    present = sum((F.bit_count(F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long"))) for w in words), F.lit(0))

    def has(i: Column) -> Column:
        word = F.element_at("_bits", F.floor(i / DAYS_A_WORD).cast("int") + 1)
        return F.call_function("shiftright", word, i % DAYS_A_WORD).bitwiseAND(1) == 1

    short = held.where(present < total).select("key", bits.alias("_bits"))
    missing = F.filter(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: ~has(i))
    return short.withColumn("_missing", missing).select(
        "key", F.lit(total).alias("days"), F.size("_missing").alias("missing_days"),
        F.date_add(start, F.element_at("_missing", 1)).alias("first_missing"),
        F.date_add(start, F.element_at("_missing", -1)).alias("last_missing"),
    )


def coverage_drop(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Keys seen before and absent on the latest day, with the day they were last seen.

    One aggregation per key; the latest day is a scalar subquery over it.
    """
    seen = df.groupBy(F.col(key).alias("key")).agg(F.max(day(ts)).alias("last_day"))
    latest = seen.agg(F.max("last_day")).scalar()
    return seen.where(F.col("last_day") < latest)
