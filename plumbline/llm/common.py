"""What the corpus operators share: batches of texts, tables in the shared folder, ranks without hot windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import shared_folder

#: Lets a query delete its shuffle files as soon as it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The white space of the contracts, one byte each.
BLANKS = b" \t\n\x0b\x0c\r"
#: The folders of the tables written since the innermost ``finished`` began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a folder of its own below the shared root and read it back.

    Cuts the lineage: what follows survives the loss of the executors that made it.  Nothing reads
    the shuffles behind the table any more, so they are freed when it has been written, and chains of
    such tables hold the shuffle files of one link at a time.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, f"llm-{label}"), spark.conf.get(FREE_SHUFFLES, None)
    if (written := _written.get()) is not None:
        written.append(path)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()`` as a written table; the tables that ``stored`` wrote on the way to it are deleted.

    So nothing that ``make`` writes may be read by anything else later.  What was written before is left alone, and
    one may stand inside another.
    """
    token = _written.set(passed := [])
    try:
        df = make()
    finally:
        _written.reset(token)
    found = stored(df, label)
    spark = df.sparkSession
    for path in passed:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return found


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that only their texts become Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is an empty text."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts; a null is an empty text."""
    return [v or "" for v in column.to_pylist()]


def salts(spark: SparkSession) -> int:
    """How many parts a key is cut into before anything sorts or numbers its rows."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rank_within(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``rank``, numbering the rows of equal ``keys`` (not null) from 0 without gaps.

    A key is cut into salted parts by a hash of ``order``; a part is numbered by
    itself and shifted by the sizes of the parts before it.  So the rows of a hot
    key are never in one task, and the ranks depend on values alone.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts(df.sparkSession))).cast("int")
    parted = df.withColumn("_part", part)
    cells = [*keys, "_part"]
    sizes = parted.groupBy(*cells).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*cells, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) - 1
    return (
        parted.withColumn("_inside", inside).join(shifts, cells)
        .withColumn("rank", F.col("_shift") + F.col("_inside")).drop("_part", "_inside", "_shift")
    )


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """A written table of the rows of ``docs`` (doc_id, text, ...) with a ``key`` of their own: 0, 1, 2 ... without gaps.

    Keys follow doc_id, null after all others, then the text and the other columns, so they depend on
    values alone and rows that share one are alike in all.  Rows are dealt by ranges of all of
    these and a number of the row, so that no doc_id, however often repeated, is in one task.
    The table has all texts and lasts as long as what is read from it, so it is compressed further than others.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    marks = [f"_{key}{i}" for i in range(3)]
    marked = docs.withColumns({
        marks[0]: F.sha2("text", 256), marks[1]: F.xxhash64(F.to_json(F.struct(*others)) if others else F.lit(0)),
        marks[2]: F.monotonically_increasing_id(),
    })
    order = [F.col("doc_id").asc_nulls_last(), *[F.col(m).asc_nulls_first() for m in marks]]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop(*marks)
    rows = stored(ranged.withColumn(key, F.monotonically_increasing_id()), "keyed", "zstd")
    # A key so far is the number of its range, then its place there in 33 bits; there are few ranges.
    part = F.shiftright(key, 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    place = F.col(key).bitwiseAND((1 << 33) - 1)
    placed = rows.withColumn("_part", part).join(F.broadcast(shifts), "_part")
    return placed.withColumn(key, F.col("_shift") + place).drop("_part", "_shift")
