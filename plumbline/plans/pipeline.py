"""The detail-to-aggregate pipeline whose tables the checks look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_all, day


def clean_half_hourly(
    raw: DataFrame, *, ts: str, reading: str, devices: str, key_parts: Sequence[str]
) -> DataFrame:
    """Drop rows without a time or without active devices and derive the calendar columns."""
    at = F.col(ts)
    return (
        raw.where(at.isNotNull() & (F.col(devices) > 0))
        .withColumn("hour_of_day", F.hour(at))
        .withColumn("minute_of_hour", F.minute(at))
        .withColumn("half_hour_slot", F.hour(at) * 2 + F.when(F.minute(at) >= 30, 1).otherwise(0))
        .withColumn("day_of_week", F.dayofweek(at))
        .withColumn("is_weekend", F.dayofweek(at).isin(1, 7))
        .withColumn("composite_key", F.concat_ws("_", *[F.col(c).cast("string") for c in key_parts]))
        .withColumn("reading_per_device", F.try_divide(F.col(reading).cast("double"), F.col(devices).cast("double")))
        .withColumn("collection_date", day(at))
    )


def peak_day(silver: DataFrame, *, key: str, ts: str, reading: str) -> DataFrame:
    """Per key and day: total, average, peak and the earliest time of the peak."""
    # The negated distance from a fixed moment prefers the earlier of equal peaks.
    earliness = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") - F.col(ts).cast("timestamp_ntz")
    return silver.groupBy(F.col(key).alias("key"), day(ts).alias("day")).agg(
        F.sum(reading).alias("daily_total"),
        F.avg(reading).alias("average_reading"),
        F.max(reading).alias("peak"),
        F.max_by(ts, F.struct(F.col(reading), earliness)).alias("peak_timestamp"),
    )


def load_profile(silver: DataFrame, *, key: str, reading: str) -> DataFrame:
    """Average reading and number of readings per key and half-hour slot."""
    return silver.groupBy(F.col(key).alias("key"), "half_hour_slot").agg(
        F.avg(reading).alias("average_reading"), count_all().alias("readings")
    )
