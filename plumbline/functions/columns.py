"""Small column expressions used across the checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def day(value: ColumnLike) -> Column:
    """Calendar day of a timestamp; a cast, so the zone-less type stays zone-less."""
    return column(value).cast("date")


def moment(value: str) -> Column:
    """A zone-less timestamp literal."""
    return F.to_timestamp_ntz(F.lit(value))


def minutes_between(earlier: ColumnLike, later: ColumnLike) -> Column:
    """Whole minutes between two zone-less timestamps, without a detour through a time zone."""
    apart = column(later) - column(earlier)
    day_part, hour, minute = (F.extract(F.lit(part), apart) for part in ("DAY", "HOUR", "MINUTE"))
    return day_part.cast("bigint") * 1440 + hour.cast("bigint") * 60 + minute.cast("bigint")


def count_all() -> Column:
    return F.count(F.lit(1))


def share(part: ColumnLike, whole: ColumnLike, digits: int = 6) -> Column:
    """part / whole, null when whole is zero."""
    return F.round(F.try_divide(column(part).cast("double"), column(whole).cast("double")), digits)


def zero_is_pass(violations: ColumnLike) -> Column:
    """The band of null, duplicate and range checks: nothing found passes."""
    return F.when(column(violations) == 0, "pass").otherwise("fail")


def banded(value: ColumnLike, pass_to: float, warn_to: float) -> Column:
    """pass / warn / fail by upper bounds; a value that cannot be computed warns."""
    v = column(value)
    return (
        F.when(v.isNull(), "warn")
        .when(v <= pass_to, "pass")
        .when(v <= warn_to, "warn")
        .otherwise("fail")
    )


def severity_rank(value: ColumnLike) -> Column:
    """Worst first; anything that is not an exact severity comes last."""
    v = column(value)
    return F.when(v == "fail", 0).when(v == "warn", 1).when(v == "pass", 2).otherwise(3)


def text_of(columns: Iterable[str]) -> list[Column]:
    """The columns as strings under their own names; null stays null."""
    return [F.col(c).cast("string").alias(c) for c in columns]
