"""Table ids and table metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

DEFAULT_DATABASE = "default"


def resolve_ids(df: DataFrame, table_id: str = "table_id", default_database: str = DEFAULT_DATABASE) -> DataFrame:
    """Split ids into (catalog, database, name).

    One part takes the default database, two are database and name, three name
    the catalog first.  ``legacy_db`` and ``legacy_name`` keep the plain split
    on the first dot.
    """
    given = F.col(table_id)
    parts = F.split(given, r"\.", 3)
    n = F.size(parts)
    dotted = n > 1
    return df.select(
        "*",
        F.when(n == 3, parts[0]).alias("catalog"),
        F.when(n == 3, parts[1]).when(n == 2, parts[0]).otherwise(F.lit(default_database)).alias("database"),
        F.element_at(parts, -1).alias("name"),
        F.when(dotted, F.substring_index(given, ".", 1)).otherwise(F.lit(default_database)).alias("legacy_db"),
        F.when(dotted, F.element_at(F.split(given, r"\.", 2), 2)).otherwise(given).alias("legacy_name"),
    )


def quoted(table_id: str) -> str:
    """The id as an identifier Spark SQL accepts whatever characters it has."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in table_id.split(".", 2))


def metadata_rows(table_id: str, df: DataFrame, partition_keys: tuple[str, ...] = ()) -> list[tuple]:
    """One row per column of an open table, in the order of ``schemas.COLUMN_METADATA``."""
    database, _, name = table_id.rpartition(".")
    return [
        (table_id, database or DEFAULT_DATABASE, name, None, i, f.name, f.dataType.simpleString(),
         f.metadata.get("comment"), f.name in partition_keys, None, None, None)
        for i, f in enumerate(df.schema.fields)
    ]


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column metadata of open tables; reads no data."""
    rows = [row for table_id, df in tables.items() for row in metadata_rows(table_id, df)]
    return spark.createDataFrame(rows, schemas.COLUMN_METADATA)


def table_columns(spark: SparkSession, table_id: str) -> DataFrame:
    """Column metadata of a catalog table, or a single row that carries the error."""
    database, _, name = table_id.rpartition(".")
    try:
        df = spark.table(quoted(table_id))
        listed = spark.catalog.listColumns(quoted(table_id))
        details = {
            r["col_name"]: r["data_type"]
            for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table_id)}").collect()
        }
    except (AnalysisException, ParseException) as error:
        row = (table_id, database or DEFAULT_DATABASE, name, *[None] * 8, str(error))
        return spark.createDataFrame([row], schemas.COLUMN_METADATA)
    partitions = {c.name for c in listed if c.isPartition}
    rows = [
        (table_id, database or DEFAULT_DATABASE, name, details.get("Location"), i, f.name,
         f.dataType.simpleString(), f.metadata.get("comment"), f.name in partitions,
         details.get("Type"), details.get("InputFormat") or details.get("Provider"), None)
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, schemas.COLUMN_METADATA)


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare (table_id, column, type, is_partition) of two metadata frames.

    ``change`` is match, missing, extra, type_changed or partition_changed.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "table_id", "column", F.col("type").alias(f"{prefix}_type"),
            F.coalesce(F.col("is_partition"), F.lit(False)).alias(f"{prefix}_partition"),
        )

    def change(e: Column, a: Column) -> Column:
        return (
            F.when(a.isNull(), "missing")
            .when(e.isNull(), "extra")
            .when(e != a, "type_changed")
            .when(F.col("expected_partition") != F.col("actual_partition"), "partition_changed")
            .otherwise("match")
        )

    return side(expected, "expected").join(side(actual, "actual"), ["table_id", "column"], "full_outer").select(
        "table_id", "column", "expected_type", "actual_type",
        change(F.col("expected_type"), F.col("actual_type")).alias("change"),
    )


def union_distinct(*lists: DataFrame, key: str = "table_id") -> DataFrame:
    """Ids of several lists, each once, placed where it first occurs.

    Each list is (key, position).  The first list wins over later ones.
    """
    tagged = None
    for i, ids in enumerate(lists):
        part = ids.select(F.col(key), F.struct(F.lit(i).alias("list_no"), F.col("position")).alias("_at"))
        tagged = part if tagged is None else tagged.unionAll(part)
    return (
        tagged.groupBy(key)
        .agg(F.min(F.struct(F.col("_at.list_no"), F.col("_at.position").cast("bigint").alias("position"))).alias("_at"))
        .select(key, "_at.list_no", "_at.position")
    )
