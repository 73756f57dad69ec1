"""Opening file streams and draining them into tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_folder

# State on disk, of which a batch uploads the changes and not a snapshot.
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def open_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, max_bytes_per_trigger: str | None = None
) -> DataFrame:
    """Parquet files under ``path``, which may also be a single file, as a stream.

    ``max_bytes_per_trigger`` bounds the micro-batch, and with it what one key
    can hold in a stateful task at a time.
    """
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    # As a pattern, a path to one file is accepted as well as one to a folder.
    return reader.parquet(f"{folder}/{{{name}}}")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; large state needs it."""
    before = {name: spark.conf.get(name, None) for name in _STATE_SETTINGS}
    for name, value in _STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def rows_path(folder: str) -> str:
    """Where :func:`drain` puts its rows; can be opened as a stream in turn."""
    return f"{folder}/rows"


def write_drained(df: DataFrame, path: str, batch: int) -> None:
    """The rows of one micro-batch; a repeated batch replaces its own rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_drained(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches under ``path``; ``schema`` includes the column ``batch``, which prunes."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def drain(
    stream: DataFrame, label: str, output_mode: str = "append", folder: str | None = None,
    each: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Process all that is available and read back what was emitted.

    ``each`` may turn a micro-batch into the rows to keep.  With the same
    ``folder`` a later call goes on from the checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, label)
    rows = rows_path(folder)

    def write(batch: DataFrame, number: int) -> None:
        if each is None:
            write_drained(batch, rows, number)
            return
        # The batch is read more than once; a lost executor reads it again from the source.
        batch.persist()
        try:
            write_drained(each(batch, number), rows, number)
        finally:
            batch.unpersist()

    schema = T.StructType(stream.schema.fields)
    # The table exists from the start, also when no batch ever comes.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{rows}/batch=-1")
    with rocksdb_state(spark):
        query = (
            stream.writeStream.outputMode(output_mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return read_drained(spark, rows, T.StructType(schema.fields + [T.StructField("batch", T.LongType())]))
