"""Versioned table understandings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import split_position


def latest_version(understandings: DataFrame, key: Sequence[str] = ("table_id",), version: str = "version") -> DataFrame:
    """The newest row of every table.

    Only (key, version) is aggregated; the wide rows (texts, embeddings) are
    then selected by a semi-join and never sorted.  The version is part of the
    join key, so a table with very many versions stays spread out.
    """
    newest = understandings.groupBy(*key).agg(F.max(version).alias(version))
    return understandings.join(newest, [*key, version], "left_semi")


def assign_versions(
    incoming: DataFrame, stored: DataFrame, order: Sequence[str], key: str = "table_id",
) -> DataFrame:
    """Number new rows on from the highest stored version of their table.

    Failed parses take a version like all others.  ``stored`` is (key,
    version); ``order`` must be total within a table.
    """
    base = stored.groupBy(key).agg(F.max("version").alias("size"))
    return split_position(incoming, [key], order, "version", base)
