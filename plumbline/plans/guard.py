"""Running one query under the guardrails: read-only, bounded in time, rows and bytes."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_audit

# The published default guardrails.
TIMEOUT_SECONDS = 30
MAX_BYTES = 200 * 1024 * 1024
MAX_RESULT_ROWS = 100  # the header counts as one of them
SAMPLE_ROWS = 25
#: Groups that partitions are gathered in before their first rows meet.
FANS = 64


@dataclass
class Outcome:
    status: str
    rows: list = field(default_factory=list)
    error: str | None = None
    runtime_ms: int | None = None
    total_rows: int | None = None


@dataclass
class QueryResult:
    """What is kept of a query: a small record, never the whole result."""

    status: str
    sql: str | None = None
    runtime_ms: int | None = None
    bytes_scanned: int | None = None
    exceeded_byte_cap: bool | None = None
    row_count: int | None = None
    #: All rows of the query, and whether ``row_count`` says fewer.
    total_rows: int | None = None
    truncated: bool | None = None
    sample: list[dict[str, str | None]] | None = None
    error: str | None = None


def bounded_sample(df: DataFrame, order: list, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in a total order, every cell as text."""
    return df.orderBy(*order).limit(rows).select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def defensive_limit(df: DataFrame, rows: int = 1000) -> DataFrame:
    return df.limit(rows)


def scan_bytes(df: DataFrame) -> int:
    """Upper bound of the bytes the plan reads, after pruning, before it runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def counted_sample(df: DataFrame, order: list, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``rows`` rows in a total order, with ``total_rows`` and ``truncated``.

    The number of all rows is a scalar subquery that needs no column, so of a table it reads the footers.
    """
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(*order).limit(rows).withColumn("total_rows", total).withColumn("truncated", F.col("total_rows") > rows)


def first_and_count(df: DataFrame, rows: int) -> DataFrame:
    """(total, found): the number of all rows and the first ``rows`` of them as structs, in one pass over ``df``.

    Each partition gives its first rows only; those of some partitions are cut again before all meet, so no
    task gathers more than ``rows`` for each of its partitions.
    """
    at = F.monotonically_increasing_id()
    # The id is the partition, then the place there in 33 bits.
    numbered = df.select(F.struct("*").alias("row"), at.alias("at"))
    place, part = F.col("at").bitwiseAND((1 << 33) - 1), F.shiftright("at", 33)
    first = F.collect_list(F.when(place < rows, F.struct("at", "row")))
    some = numbered.groupBy(F.pmod(part, F.lit(FANS)).alias("fan")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(first), 1, rows).alias("found"))
    met = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, rows)
    return some.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), met.alias("found"))


def collect_guarded(
    df: DataFrame, *, limit: int, timeout_seconds: float | None = TIMEOUT_SECONDS, counted: bool = False
) -> Outcome:
    """At most ``limit`` rows; jobs still running at the timeout (if there is one) are cancelled.

    With ``counted`` the whole frame runs, so that ``total_rows`` is the number of all its rows.
    """
    context = df.sparkSession.sparkContext
    group = f"plumbline-{uuid.uuid4().hex}"
    outcome = Outcome("timeout")

    def work() -> None:
        context.setJobGroup(group, "guarded query", interruptOnCancel=True)
        try:
            if counted:
                whole = first_and_count(df, limit).first()
                outcome.total_rows, outcome.rows = whole["total"], [tuple(f["row"]) for f in whole["found"]]
            else:
                outcome.rows = df.limit(limit).collect()
            outcome.status = "ok"
        except Exception as error:  # whatever went wrong becomes the record of this query
            if outcome.error is None:
                outcome.status, outcome.error = "failed", str(error)

    started = time.monotonic()
    worker = InheritableThread(target=work, daemon=True)
    worker.start()
    worker.join(timeout_seconds)
    if worker.is_alive():
        context.cancelJobGroup(group)
        return Outcome("timeout", error=f"stopped after {timeout_seconds} s")
    outcome.runtime_ms = int((time.monotonic() - started) * 1000)
    return outcome


def run_query(
    df: DataFrame, *, timeout_seconds: float = TIMEOUT_SECONDS, max_bytes: int = MAX_BYTES,
    enforce_bytes: bool = False, sql: str | None = None,
) -> QueryResult:
    """Run a frame and keep a record of it.

    The byte cap is reported; with ``enforce_bytes`` a plan above it is
    rejected before it runs.  Columns of the same name collapse to the last.
    """
    size = scan_bytes(df)
    if enforce_bytes and size > max_bytes:
        return QueryResult("rejected", sql, bytes_scanned=size, exceeded_byte_cap=True,
                           error=f"would read {size} bytes, more than {max_bytes}")
    names = df.columns
    texts = df.toDF(*[f"c{i}" for i in range(len(names))])
    texts = texts.select(*[F.col(c).cast("string").alias(c) for c in texts.columns])
    outcome = collect_guarded(texts, limit=MAX_RESULT_ROWS - 1, timeout_seconds=timeout_seconds, counted=True)
    if outcome.status != "ok":
        return QueryResult(outcome.status, sql, error=outcome.error)
    records = [dict(zip(names, row)) for row in outcome.rows]
    return QueryResult(
        "ok", sql, runtime_ms=outcome.runtime_ms, bytes_scanned=size, exceeded_byte_cap=size > max_bytes,
        row_count=len(records), total_rows=outcome.total_rows, truncated=outcome.total_rows > len(records),
        sample=records[:SAMPLE_ROWS],
    )


def run_sql(spark: SparkSession, sql: str, *, strict: bool = False, **guards: object) -> QueryResult:
    """Audit a SQL text, then run what passed."""
    verdict = sql_audit(spark.createDataFrame([(sql,)], "sql string"), strict=strict).first()
    if not verdict["ok"]:
        return QueryResult("rejected", sql, error=verdict["reason"])
    try:
        df = spark.sql(verdict["cleaned"])
    except PySparkException as error:
        return QueryResult("failed", verdict["cleaned"], error=str(error))
    return run_query(df, sql=verdict["cleaned"], **guards)
