"""Append-only logs in place of documents that change.

Rows are only ever added.  Updates, deletes and versions are read out of the
log, so a lost executor or a repeated write can always be recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ("run_id",)
) -> None:
    """Add rows to a log.

    Partition by something with few values, such as a day or a category; runs
    are too many to be folders.  Rows are sorted inside the files instead, so
    that a filter on the run skips row groups by their statistics.
    """
    spread = df.hint("rebalance", *partition_by) if partition_by else df
    spread.sortWithinPartitions(*partition_by, *sort_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows for; running it twice changes nothing."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str, schema: object | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def upsert_merge(
    log: DataFrame, key: Sequence[str], fields: Sequence[str], order: Sequence[str], present: str = "present",
) -> DataFrame:
    """The current row of every key from a log of partial updates.

    ``present`` is an array with the names of the fields an update sets, which
    tells an explicit null from a field that was left alone.  Each field takes
    the value of the last update that set it, in ``order``.  Updates are
    reduced on the map side, so a key with very many updates is no hot spot.
    """
    # max_by skips rows whose ordering is null: the updates that do not set the field.
    latest = [
        F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains(present, f), F.col("_at"))).alias(f"_m_{f}")
        for f in fields
    ]
    staged = log.withColumn("_at", F.struct(*order))
    merged = staged.groupBy(*key).agg(*latest, F.max("_at").alias("_at"))
    return merged.select(
        *key, *[F.col(f"_m_{f}")["v"].alias(f) for f in fields],
        F.col("_at")[order[0]].alias("updated_at"),
    )


def last_write(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole last row of every key, by ``order``, which must not tie within a key."""
    columns = [c for c in log.columns if c not in key]
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return log.groupBy(*key).agg(newest).select(*key, "_row.*")


def delete_by_key(log: DataFrame, deleted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``deleted``."""
    return log.join(deleted.select(*key), list(key), "left_anti")
