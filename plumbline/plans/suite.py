"""Check suites: many checks on many tables as few scans.

A suite is planned before anything runs.  A check whose table or column does
not exist, or whose types do not fit, becomes a record with status ``skipped``.  All single-value checks
of a table share one aggregation; grouping checks get a frame each.  The
evidence has one row per check.

Metrics of the shared aggregation do not raise: values are read with ``try_cast``, and
a check that meets values it cannot read is a record with status ``failed`` and their number, made by
the same job as the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import count_all, minutes_between, moment
from ..operators import groups, reconcile
from ..operators.profile import RangeRule, union_all
from . import guard

EVIDENCE = (
    "check_id string, check_name string, category string, target_table string, kind string,"
    " status string, observed double, row_count bigint, sample array<string>, error string"
)

#: What a run adds: time, SQL, named cells, and how many rows there were behind a sample that may be cut.
RUN_EVIDENCE = EVIDENCE + (
    ", runtime_ms bigint, sql string, cells array<map<string,string>>, total_rows bigint, truncated boolean"
)

SCALAR_KINDS = ("row_count", "freshness", "nulls", "range", "accepted")
GROUP_KINDS = (
    "rows_by_day", "duplicate_grain", "distribution", "schema", "completeness", "coverage", "cutoff",
    "reconcile_days", "reconcile_keys", "aggregate",
)
#: Kinds that compare with the table named by the option ``other``.
TWO_TABLES = ("reconcile_days", "reconcile_keys", "aggregate")

# Cheap before dear: one row per table, then one row per value or day, then one per grain value.
_COST = {k: 0 for k in SCALAR_KINDS} | {"rows_by_day": 1, "distribution": 2, "duplicate_grain": 3, "sql": 4} | {
    "schema": 0, "cutoff": 1, "coverage": 2, "completeness": 3, "reconcile_days": 2, "reconcile_keys": 4, "aggregate": 4,
}


@dataclass(frozen=True)
class CheckSpec:
    """One check.  ``columns`` are those it reads; ``options`` depend on the kind."""

    id: str
    target_table: str
    kind: str
    columns: tuple[str, ...] = ()
    options: Mapping[str, object] = field(default_factory=dict)
    name: str | None = None
    intent: str | None = None
    category: str | None = None
    risk_level: str = "low"
    expected_outcome: str | None = None
    sql: str | None = None

    @property
    def title(self) -> str:
        return self.name or f"{self.kind} of {self.target_table}"

    @property
    def kind_category(self) -> str:
        return self.category or _CATEGORY.get(self.kind, "business_rule")


_CATEGORY = {
    "row_count": "row_count", "rows_by_day": "row_count", "freshness": "freshness", "nulls": "null_check",
    "duplicate_grain": "duplicate_grain", "range": "business_rule", "accepted": "business_rule",
    "distribution": "business_rule", "schema": "schema", "completeness": "row_count", "coverage": "row_count",
    "cutoff": "freshness", "reconcile_days": "reconciliation", "reconcile_keys": "reconciliation",
    "aggregate": "aggregation_sanity",
}


def _identity(spec: CheckSpec) -> list[Column]:
    return [
        F.lit(spec.id).alias("check_id"), F.lit(spec.title).alias("check_name"),
        F.lit(spec.kind_category).alias("category"), F.lit(spec.target_table).alias("target_table"),
        F.lit(spec.kind).alias("kind"),
    ]


def _evidence_row(spec: CheckSpec, observed: Column, row_count: Column, sample: Column, error: Column | None = None) -> Column:
    """A record; with an ``error`` that is not null it has nothing but that."""
    error = F.lit(None).cast("string") if error is None else error
    kept = lambda c, kind: F.when(error.isNull(), c).cast(kind)
    return F.struct(
        *_identity(spec), F.when(error.isNull(), "ok").otherwise("failed").alias("status"), kept(observed, "double").alias("observed"),
        kept(row_count, "bigint").alias("row_count"), kept(sample, "array<string>").alias("sample"), error.alias("error"),
    )


def why_skipped(spec: CheckSpec, tables: Mapping[str, DataFrame]) -> str | None:
    """The reason a check cannot be planned, from schemas alone."""
    if spec.kind not in SCALAR_KINDS + GROUP_KINDS:
        return f"unknown kind {spec.kind}"
    if spec.target_table not in tables:
        return f"unknown table {spec.target_table}"
    missing = [c for c in spec.columns if c not in tables[spec.target_table].columns]
    if missing:
        return f"no column {', '.join(missing)} in {spec.target_table}"
    if spec.kind in TWO_TABLES and spec.options.get("other") not in tables:
        return f"unknown table {spec.options.get('other')}"
    try:  # types are checked on the plan; nothing runs
        (_fused if spec.kind in SCALAR_KINDS else _grouped)(tables, [spec], "2000-01-01 00:00:00").schema
    except PySparkException as error:
        return str(error).splitlines()[0]
    except (KeyError, IndexError, ValueError) as error:
        return f"{spec.kind} needs other columns or options: {error}"
    return None


@dataclass(frozen=True)
class _Metric:
    """An aggregate of the shared scan, how to read the number out of it, and the values it could not read."""

    value: Column
    read: Callable[[Column], Column] = lambda v: v
    unread: Column | None = None
    meant: str = ""


def _readable(df: DataFrame, name: str, kind: str) -> tuple[Column, Column | None]:
    """A column as a type, and the number of texts that are none; other types are left to the analyser."""
    if df.schema[name].dataType.typeName() != "string":
        return F.col(name).cast(kind) if kind == "timestamp_ntz" else F.col(name), None
    value = F.col(name).try_cast(kind)
    return value, F.count_if(F.col(name).isNotNull() & value.isNull())


def _scalar(df: DataFrame, spec: CheckSpec, as_of: str) -> _Metric:
    if spec.kind == "row_count":
        return _Metric(count_all())
    (name,) = spec.columns
    if spec.kind == "freshness":
        value, unread = _readable(df, name, "timestamp_ntz")
        return _Metric(F.max(value), lambda v: minutes_between(v, moment(as_of)), unread, "timestamp")
    if spec.kind == "nulls":
        return _Metric(F.count_if(F.col(name).isNull()))
    if spec.kind == "range":
        value, unread = _readable(df, name, "double")
        rule = RangeRule(spec.id, name, spec.options.get("low"), spec.options.get("high"))
        return _Metric(F.count_if(rule.violated(value)), unread=unread, meant="number")
    # An allowed value that is none of the column's type matches nothing.
    kind = df.schema[name].dataType
    known = [F.lit(str(v)).try_cast(kind) for v in spec.options["allowed"]]
    return _Metric(F.count_if(F.col(name).isNotNull() & ~F.coalesce(F.col(name).isin(*known), F.lit(False))))


def _fused(tables: Mapping[str, DataFrame], specs: Sequence[CheckSpec], as_of: str) -> DataFrame:
    """All single-value checks of one table as one aggregation that no single value can end."""
    df = tables[specs[0].target_table]
    metrics = [_scalar(df, s, as_of) for s in specs]
    none = F.lit(0).cast("bigint")
    row = df.agg(*[
        F.struct(m.value.alias("value"), (none if m.unread is None else m.unread).alias("unread")).alias(f"v{i}") for i, m in enumerate(metrics)
    ])
    records = []
    for i, (s, m) in enumerate(zip(specs, metrics)):
        value, unread = F.col(f"v{i}.value"), F.col(f"v{i}.unread")
        error = F.when(unread > 0, F.concat(unread.cast("string"), F.lit(f" values of {', '.join(s.columns)} are no {m.meant}")))
        records.append(_evidence_row(s, m.read(value), F.lit(1), F.array(value.cast("string")), error))
    return row.select(F.inline(F.array(*records)))


def _sampled(rows: DataFrame, order: Sequence[Column], size: int) -> Column:
    """At most ``size`` rows as JSON texts, as a scalar subquery."""
    texts = rows.orderBy(*order).limit(size).select(F.to_json(F.struct("*")).alias("_text"))
    return texts.agg(F.sort_array(F.collect_list("_text")).alias("sample")).scalar()


def _grouped(tables: Mapping[str, DataFrame], specs: Sequence[CheckSpec], as_of: str) -> DataFrame:
    (spec,) = specs
    df, options = tables[spec.target_table], spec.options
    other = tables.get(str(options.get("other")))
    size = int(options.get("sample", 10))
    if spec.kind == "rows_by_day":
        days = groups.rows_by_day(
            df, spec.columns[0], int(spec.options.get("days", 14)), spec.options.get("since")
        )
        apart = groups.median_deviation(days)
        one = apart.agg(
            F.max("deviation").alias("observed"), count_all().alias("rows"),
            F.sort_array(F.collect_list(F.to_json(F.struct("day", "n")))).alias("sample"),
        )
        return one.select(F.inline(F.array(_evidence_row(spec, F.col("observed"), F.col("rows"), F.col("sample")))))
    if spec.kind == "duplicate_grain":
        found = groups.duplicate_grain(df, spec.columns, None)
        order = [F.col("n").desc(), *[F.col(c) for c in spec.columns]]
    elif spec.kind == "schema":
        found, order = _schema_differences(df, options["expected"]), [F.col("column")]
    elif spec.kind == "completeness":
        key, ts = spec.columns
        keys = tables.get(str(options.get("keys")))
        found = groups.completeness_by_key(df, key, ts, int(options["minimum"]), options["first_day"], options["last_day"], keys=keys)
        order = [F.col("missing_days").desc(), F.col("key")]
    elif spec.kind == "coverage":
        found, order = groups.coverage_drop(df, *spec.columns), [F.col("key")]
    elif spec.kind == "cutoff":
        days = groups.rows_by_day(df, spec.columns[0], int(options.get("days", 14)), options.get("since"))
        found = groups.cutoff_status(days, as_of, int(options.get("cutoff_hours", 9))).where("severity = 'fail'")
        order = [F.col("day")]
    elif spec.kind == "reconcile_days":
        days = reconcile.reconcile_by_day(df, spec.columns[0], other, options["other_columns"][0])
        found, order = days.where("difference <> 0"), [F.col("day")]
    elif spec.kind == "reconcile_keys":
        found = reconcile.reconcile_keys(df, spec.columns, other, options["other_columns"])
        order = [F.col(c) for c in spec.columns]
    elif spec.kind == "aggregate":
        *keys, value = spec.columns
        found = reconcile.aggregate_sanity(df, other, keys, value, options["published"])
        order = [F.col(k) for k in keys]
    else:
        found = groups.accepted_values(df, spec.columns[0], None)
        order = [F.col("n").desc(), F.col("value")]
    # Counted over n, so that count and sample read one and the same grouping.
    counted = F.count_if(F.col("n") > 0) if "n" in found.columns else count_all()
    one = found.agg(counted.alias("rows")).select("rows", _sampled(found, order, size).alias("sample"))
    return one.select(F.inline(F.array(_evidence_row(spec, F.col("rows"), F.col("rows"), F.col("sample")))))


def _schema_differences(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column, expected, actual) where names or types differ; no row of the table is read."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, expected.get(c), actual.get(c)) for c in sorted({*expected, *actual}) if expected.get(c) != actual.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string")


def _plan(
    tables: Mapping[str, DataFrame], specs: Sequence[CheckSpec], as_of: str
) -> tuple[list[tuple[list[CheckSpec], DataFrame]], list[tuple[CheckSpec, str]]]:
    skipped = [(s, why) for s in specs if (why := why_skipped(s, tables))]
    left_out = {s.id for s, _ in skipped}
    runnable = sorted((s for s in specs if s.id not in left_out), key=lambda s: _COST[s.kind])
    planned: list[tuple[list[CheckSpec], DataFrame]] = []
    for table_id in tables:
        scalar = [s for s in runnable if s.target_table == table_id and s.kind in SCALAR_KINDS]
        if scalar:
            planned.append((scalar, _fused(tables, scalar, as_of)))
    planned += [([s], _grouped(tables, [s], as_of)) for s in runnable if s.kind in GROUP_KINDS]
    return planned, skipped


def evidence(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Sequence[CheckSpec], as_of: str
) -> DataFrame:
    """One row per check, lazily."""
    planned, skipped = _plan(tables, specs, as_of)
    rows = [
        (s.id, s.title, s.kind_category, s.target_table, s.kind, "skipped", None, None, None, why)
        for s, why in skipped
    ]
    frames = [df for _, df in planned]
    if rows or not frames:
        frames.append(spark.createDataFrame(rows, EVIDENCE))
    return union_all(frames)


def run_suite(
    spark: SparkSession, tables: Mapping[str, DataFrame], specs: Sequence[CheckSpec], as_of: str, *,
    timeout_seconds: float | None = None, sql_timeout_seconds: float = guard.TIMEOUT_SECONDS,
) -> DataFrame:
    """Run every check and keep the outcome of each, whatever happens to the others.

    Values that a check cannot read are part of the shared scan's result.  Only when the table itself fails (a column
    that is computed by something that raises) does a scan end; its checks are then run in halves until those
    that really fail stand alone.  A timeout is recorded
    for all checks of a scan and starts no further jobs.  SQL checks (kind ``sql``)
    pass the read-only audit first and have a timeout of their own.
    """
    records: list[tuple] = []

    def record(spec: CheckSpec, status: str, error: str | None = None, runtime: int | None = None) -> tuple:
        return (
            spec.id, spec.title, spec.kind_category, spec.target_table, spec.kind, status, None, None, None, error,
            runtime, spec.sql, None, None, None,
        )

    text_checks = [s for s in specs if s.kind == "sql"]
    planned, skipped = _plan(tables, [s for s in specs if s.kind != "sql"], as_of)
    records += [record(s, "skipped", why) for s, why in skipped]
    queue = list(planned)
    while queue:
        group, frame = queue.pop(0)
        outcome = guard.collect_guarded(frame, limit=len(group), timeout_seconds=timeout_seconds)
        if outcome.status == "ok":
            texts = {s.id: s.sql for s in group}
            for r in outcome.rows:
                cells = None if r["sample"] is None else [_cells(text) for text in r["sample"]]
                total = r["row_count"]
                cut = None if total is None or cells is None else total > len(cells)
                records.append((*r, outcome.runtime_ms, texts[r["check_id"]], cells, total, cut))
        elif len(group) > 1 and outcome.status == "failed":
            half = len(group) // 2
            queue = [(part, _fused(tables, part, as_of)) for part in (group[:half], group[half:])] + queue
        else:
            records += [record(s, outcome.status, outcome.error, outcome.runtime_ms) for s in group]
    for spec in text_checks:
        result = guard.run_sql(spark, spec.sql or "", timeout_seconds=sql_timeout_seconds)
        sample = None if result.sample is None else [str(r) for r in result.sample]
        records.append((
            spec.id, spec.title, spec.kind_category, spec.target_table, spec.kind, result.status, None, result.row_count, sample,
            result.error, result.runtime_ms, result.sql, result.sample, result.total_rows, result.truncated,
        ))
    return spark.createDataFrame(records, RUN_EVIDENCE)


def _cells(text: str | None) -> dict[str, str | None]:
    """A sampled value by name: the fields of a JSON row, or the value observed."""
    try:
        row = json.loads(text) if text is not None and text.startswith("{") else None
    except ValueError:
        row = None
    if row is None:
        return {"observed": text}
    return {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in row.items()}


def execution_records(
    evidence_rows: DataFrame, specs: DataFrame, run_id: str, executed_at: str
) -> DataFrame:
    """Evidence in the shape of the execution log (``schemas.EXECUTIONS``)."""
    about = specs.select(F.col("id").alias("check_id"), F.col("intent").alias("purpose"), F.col("sql").alias("_sql"))
    for c, kind in (("runtime_ms", "bigint"), ("sql", "string"), ("cells", "array<map<string,string>>")):
        if c not in evidence_rows.columns:
            evidence_rows = evidence_rows.withColumn(c, F.lit(None).cast(kind))
    return evidence_rows.join(about, "check_id", "left").select(
        F.lit(run_id).alias("run_id"), F.col("check_id").alias("query_id"), "check_name", "purpose", "category",
        "target_table", F.coalesce("sql", "_sql").alias("sql"), "status", "runtime_ms", "row_count",
        F.coalesce("cells", F.transform("sample", lambda s: F.create_map(F.lit("value"), s))).alias("result_sample"), "error",
        F.lit(executed_at).cast("timestamp").alias("executed_at"),
    )


def spec_frame(spark: SparkSession, specs: Sequence[CheckSpec]) -> DataFrame:
    rows = [
        (s.id, s.title, s.intent, s.target_table, s.sql, s.risk_level, s.expected_outcome, s.kind_category)
        for s in specs
    ]
    return spark.createDataFrame(rows, schemas.CHECK_SPECS)
