"""Positions and neighbours inside a key that may hold most of the table.

A plain window over ``partitionBy(key)`` puts a whole key into one task, and
cutting keys by day only helps until one day is hot.  Here the rows are first
laid out in slices of even size along (key, order), by Spark's own sampled
range partitioning, and written to the shared folder, so that every reader sees
the same cut.  Work goes on inside (key, slice).  What a slice must know of the
ones before it travels through a frame with one row per (key, slice).

``order`` must be total within a key; only then can any group be cut.  ``keys``
must not be null, because the small frame is joined back on them.  The layout
is written when the function is called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder
from .columns import count_all

_SLICE, _ROW = "_slice", "_row"


def lay_out(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None, numbered: bool = False
) -> DataFrame:
    """Write ``df`` in even slices along (keys, order) and read it back with its slice number.

    ``numbered`` sorts the slices and adds ``_row``, which counts up by one
    along a slice.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "slices")
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A number given outright is kept as it is at run time, so the id of a partition is its rank.
    sliced = df.repartitionByRange(n, *keys, *order)
    if numbered:
        sliced = sliced.sortWithinPartitions(*keys, *order).withColumn(_ROW, F.monotonically_increasing_id())
    sliced = sliced.withColumn(_SLICE, F.spark_partition_id())
    sliced.write.parquet(folder)
    return spark.read.schema(sliced.schema).parquet(folder)


def split_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
    base: DataFrame | None = None, slices: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its key.

    ``base`` (keys, size) counts rows that come before all of ``df``; positions
    go on from there.
    """
    laid = lay_out(df, keys, order, slices, numbered=True)
    sizes = laid.groupBy(*keys, _SLICE).agg(count_all().alias("_size"), F.min(_ROW).alias("_first"))
    if base is not None:
        sizes = sizes.unionAll(
            base.select(
                *keys, F.lit(-1).alias(_SLICE), F.col("size").cast("bigint").alias("_size"),
                F.lit(0).cast("bigint").alias("_first"),
            )
        )
    before = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    # What to add to the number of a row to get its position.
    shifts = sizes.select(
        *keys, _SLICE, (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return (
        laid.join(shifts, [*keys, _SLICE], "left")
        .withColumn(name, F.col(_ROW) + F.col("_shift"))
        .drop(_SLICE, _ROW, "_shift")
    )


def split_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "previous",
    slices: int | None = None,
) -> DataFrame:
    """Add ``value`` of the row before, inside the key; null for the first row."""
    laid = lay_out(df.withColumn("_value", value), keys, order, slices)
    tails = laid.groupBy(*keys, _SLICE).agg(F.max_by(F.struct("_value"), F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys, _SLICE, F.lag("_tail").over(W.partitionBy(*keys).orderBy(_SLICE)).alias("_carried")
    )
    inside = W.partitionBy(*keys, _SLICE).orderBy(*order)
    return (
        laid.withColumn("_lag", F.lag(F.struct("_value")).over(inside))
        .join(carried, [*keys, _SLICE], "left")
        .withColumn(name, F.coalesce(F.col("_lag"), F.col("_carried"))["_value"])
        .drop(_SLICE, "_value", "_lag", "_carried")
    )


def chunked_text(
    df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], separator: str = "; ",
    chunk_size: int = 1000, name: str = "texts", slices: int | None = None,
) -> DataFrame:
    """Join texts per key in order, ``chunk_size`` texts to a row.

    A key with more texts than that gets several rows, numbered from 0 by
    ``chunk``, so no task ever holds an unbounded list and no text is lost.
    """
    placed = split_position(df, keys, order, "_at", slices=slices).withColumn(
        "chunk", F.floor((F.col("_at") - 1) / F.lit(chunk_size))
    )
    items = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(text).alias("_text"))))
    return placed.groupBy(*keys, "chunk").agg(
        F.array_join(F.transform(items, lambda x: x["_text"]), separator).alias(name),
        count_all().alias("n_texts"),
    )
