"""Source against destination, without joining the two tables.

Both sides are put under each other with one marker column each and grouped
once: a single shuffle whose map side has already reduced every hot key, in
place of two aggregations and an outer join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day


def reconcile_by_day(source: DataFrame, source_ts: str, target: DataFrame, target_ts: str) -> DataFrame:
    """Rows per day on both sides and their difference; a side without the day has 0."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = source.select(day(source_ts).alias("day"), one.alias("s"), none.alias("t")).unionAll(
        target.select(day(target_ts).alias("day"), none.alias("s"), one.alias("t"))
    )
    return (
        both.groupBy("day")
        .agg(F.sum("s").alias("source_rows"), F.sum("t").alias("target_rows"))
        .withColumn("difference", F.col("target_rows") - F.col("source_rows"))
    )


def reconcile_keys(
    source: DataFrame, source_keys: Sequence[str], target: DataFrame, target_keys: Sequence[str]
) -> DataFrame:
    """Keys that only one side has.  ``missing_in`` names the other side."""
    names = list(source_keys)
    here, away = F.lit(True), F.lit(False)
    both = source.select(*names, here.alias("s"), away.alias("t")).unionAll(
        target.select(*[F.col(t).alias(s) for s, t in zip(names, target_keys)], away.alias("s"), here.alias("t"))
    )
    sides = both.groupBy(*names).agg(F.max("s").alias("in_source"), F.max("t").alias("in_target"))
    return sides.where(F.col("in_source") != F.col("in_target")).select(
        *names, F.when(F.col("in_source"), "target").otherwise("source").alias("missing_in")
    )


def aggregate_sanity(
    detail: DataFrame, published: DataFrame, keys: Sequence[str], value: str, columns: Mapping[str, str],
    tolerance: float = 0.005, only_problems: bool = True, relative: float = 1e-12,
) -> DataFrame:
    """Derive a published aggregate again from its detail rows and compare.

    ``keys`` are columns of both frames.  ``columns`` maps ``total``, ``average``
    and ``peak`` to the published column; leave out what is not published.
    ``status`` is match, differs, only_detail, only_published or duplicate_published (a key published more than
    once, whatever the values; the largest are shown).  Totals and averages are added up in decimals of
    nine places, so they do not depend on the order of rows; values match that differ by no more than ``tolerance`` or
    than ``relative`` of the published one.  A total beyond 29 digits or of values that are no numbers is null, and
    differs from a published number.
    """
    unset = F.lit(None).cast("double")
    parts = list(columns)
    both = detail.select(
        *keys, F.col(value).cast("double").alias("_value"), F.lit(True).alias("_detail"),
        *[unset.alias(f"published_{p}") for p in parts],
    ).unionAll(
        published.select(
            *keys, unset.alias("_value"), F.lit(False).alias("_detail"),
            *[F.col(c).cast("double").alias(f"published_{p}") for p, c in columns.items()],
        )
    )
    exact = F.try_sum(F.col("_value").try_cast("decimal(38,9)"))
    readable = F.count_if(F.col("_value").isNotNull() & F.col("_value").try_cast("decimal(38,9)").isNull()) == 0
    total = F.when(readable, exact.cast("double"))
    again = {"total": total, "average": F.try_divide(total, F.count("_value")), "peak": F.max("_value")}
    grouped = both.groupBy(*keys).agg(
        F.max("_detail").alias("_has_detail"),
        F.min("_detail").alias("_no_published"),
        F.count_if(~F.col("_detail")).alias("_published_rows"),
        *[again[p].alias(f"derived_{p}") for p in parts],
        *[F.max(f"published_{p}").alias(f"published_{p}") for p in parts],
    )
    apart = F.lit(False)
    for p in parts:
        derived, stated = F.col(f"derived_{p}"), F.col(f"published_{p}")
        # A missing value equals only a missing value.
        apart = apart | F.coalesce(
            F.abs(derived - stated) > F.greatest(F.lit(tolerance), relative * F.abs(stated)), derived.isNull() != stated.isNull()
        )
    compared = grouped.withColumn(
        "status",
        F.when(F.col("_published_rows") > 1, "duplicate_published")
        .when(~F.col("_has_detail"), "only_published")
        .when(F.col("_no_published"), "only_detail")
        .when(apart, "differs")
        .otherwise("match"),
    ).drop("_has_detail", "_no_published", "_published_rows")
    return compared.where(F.col("status") != "match") if only_problems else compared
