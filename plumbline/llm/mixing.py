"""Mixing sources to target weights by entropy balancing.

Of all document rates that give each source its target of words, the ones closest to taking
every document once (in relative entropy, at most three times) tilt exponentially with size:
rate = min(3, exp(multiplier * size / mean size)).  The multipliers solve the convex dual; a
Newton iteration is one grouped sum over the counts of equal sizes, for all sources at once.
Rates are rounded into whole copies along the sizes of a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import finished, rank_within, slices, stored, utf8

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
TOLERANCE = 1e-9
ITERATIONS = 60


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) with the number of words between blanks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes = pa.array([len(t.split()) for t in utf8(part.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes], names=["doc_id", "source", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(
        run, "doc_id long, source string, size long"
    )


def numbered(df: DataFrame, order: Column) -> DataFrame:
    """Add ``number``, from 0 by ``order``, range by range; equal values of ``order`` must not repeat."""
    ranged = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shifts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_inside", inside).join(shifts, "_part").withColumn("number", F.col("_inside") + F.col("_shift")).drop(
        "_part", "_inside", "_shift"
    )


def targeted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, ...): shares by weight, at most ``most`` times a source's size.

    The level (words for a weight of one) rises until no source is above its bound; a round
    is one sum over the sources, and only the sums come to the driver.
    """
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = stored(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", cycle), "weights")
    bound = F.col("source_size") * float(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = bound <= F.col("weight") * level
        spent, open_ = weighed.agg(
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        before = level
        level = max(level, (total - spent) / open_) if open_ else math.inf
    return weighed.withColumn("target", F.least(bound, F.col("weight") * level) if math.isfinite(level) else bound)


def _rate(most: int) -> Column:
    tilt = F.col("multiplier") * F.col("size") / F.col("mean_size")
    return F.when(F.col("all_full"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(tilt, F.lit(math.log(most) + 1)))))


def balanced(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add the ``multiplier`` of each source: safeguarded Newton steps on the logarithm of its words.

    ``cells`` has (place, size, n), how often a size occurs in a source; ``sources`` has
    place, source_size, target, mean_size and least_size.
    """
    room = math.log(most)
    ratio = F.log(F.col("target") / F.col("source_size"))
    state = sources.withColumn("all_full", (F.col("source_size") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)))
    state = state.withColumn("multiplier", F.lit(0.0)).withColumn("off", F.lit(0.0))
    state = state.withColumn("low", F.when(F.col("all_full"), 0.0).otherwise(F.least(F.lit(0.0), ratio * F.col("mean_size") / F.col("least_size"))))
    state = state.withColumn("high", F.when(F.col("all_full"), 0.0).otherwise(room * F.col("mean_size") / F.col("least_size")))
    state = stored(state, "multipliers")
    columns = state.columns
    for _ in range(ITERATIONS):
        rate, words = _rate(most), F.col("n") * F.col("size")
        sums = cells.join(state.select("place", "multiplier", "mean_size", "all_full"), "place").groupBy("place").agg(
            F.sum(words * rate).alias("words"),
            F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("mean_size")).otherwise(0.0)).alias("slope"),
        )
        off = F.log(F.col("words") / F.col("target"))
        here = F.col("multiplier")
        stepped = state.drop("off").join(sums, "place").withColumn("off", F.when(F.col("all_full"), 0.0).otherwise(off))
        stepped = stepped.withColumn("low", F.when(F.col("off") < 0, here).otherwise(F.col("low")))
        stepped = stepped.withColumn("high", F.when(F.col("off") > 0, here).otherwise(F.col("high")))
        newton = here - F.col("off") * F.col("words") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        move = F.when(F.abs("off") <= TOLERANCE, here).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(stepped.withColumn("multiplier", move).select(columns), "multipliers")
        worst = state.agg(F.max(F.abs("off"))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row of ``docs`` (doc_id, source, text).

    ``taken`` is copies times size, no more than ``most`` sizes.  Along the sizes of a source the
    parts of copies add up, and a document gets one more copy where the sum passes a whole; so a
    source misses its target by about the size of one document.  A null source is a source of its
    own, the last; null and empty texts have no words, and a source without words has target 0.
    Repeated rows and null ids are rows like any other; other columns are ignored; an empty table
    gives an empty result.  Equal tables give equal results.
    """
    rows = stored(sized(docs), "sizes")
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = counted.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    sources = stored(targeted(sources, weights, most).withColumnRenamed("number", "place"), "targets")
    # Sources get the number of their place, so that a null one joins like the rest.
    named = sources.select(F.col("source").alias("named"), "place")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).select("doc_id", "place", "size")
    cells = stored(rows.groupBy("place", "size").agg(F.count("*").alias("n")), "cells")
    state = balanced(cells, sources, most)
    rated = cells.join(state, "place").withColumn("rate", _rate(most))
    part = F.col("rate") - F.floor("rate")
    along = Window.partitionBy("place").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.select(
        "place", "size", "source_size", "target", F.floor("rate").alias("whole"), part.alias("part"),
        F.coalesce(F.sum(F.col("n") * part).over(along), F.lit(0.0)).alias("before"),
    )
    ranked = rank_within(rows, ["place", "size"], ["doc_id"]).join(rated, ["place", "size"])
    def passed(k):
        return F.floor(F.lit(0.5) + F.col("before") + k * F.col("part"))

    copies = F.col("whole") + passed(F.col("rank") + 1) - passed(F.col("rank"))
    return ranked.withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; ids must be unique."""
    copies = finished(
        lambda: mixed(docs, weights, most).where("copies > 0").select("doc_id", F.col("copies").alias("_copies")), "copies"
    )
    repeated = docs.join(copies, "doc_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)
