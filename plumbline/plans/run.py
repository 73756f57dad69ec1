"""A whole quality run: profile, choose checks, run them, judge, report, keep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import severity_rollup
from ..sources.logs import append_log
from . import guard, report, rules, suggest, suite
from .suite import CheckSpec


#: Checks suggested for a table.
PER_TABLE = 4


@dataclass(frozen=True)
class RunResult:
    """What a run produced.  Apart from the profile all frames have a row per check or per line."""

    profile: DataFrame
    specs: Sequence[CheckSpec]
    executions: DataFrame
    findings: DataFrame
    report: DataFrame
    rollup: DataFrame


def specs_from(suggestions: DataFrame) -> list[CheckSpec]:
    """Suggestions as checks that can run; a suggestion list is short by its limit."""
    rows = suggestions.select("id", "table_id", "column", "kind", "category", "expected_outcome", "sql").collect()
    return [
        CheckSpec(
            r["id"], r["table_id"], r["kind"], (r["column"],), {"low": 0} if r["kind"] == "range" else {},
            name=f"{r['kind']} of {r['table_id']}.{r['column']}", category=r["category"],
            expected_outcome=r["expected_outcome"], sql=r["sql"],
        )
        for r in rows
    ]


def quality_run(
    spark: SparkSession, tables: Mapping[str, DataFrame], *, run_id: str, as_of: str,
    specs: Sequence[CheckSpec] | None = None, understandings: DataFrame | None = None, store: str | None = None,
    limit: int | None = None, per_table: int | None = PER_TABLE, timeout_seconds: float | None = None,
) -> RunResult:
    """Check ``tables`` as of a moment and keep the outcome.

    Without ``specs`` the checks are suggested from the profile, ``per_table`` of the most useful for every table and
    with ``limit`` no more in all.
    ``understandings`` (run_id, table_id, business_description, parsing_failed)
    fills the table section of the report.  With ``store``, executions,
    findings, rollup and report lines are appended to logs below that path.
    """
    profile = suggest.column_profile(tables)
    chosen = list(specs) if specs is not None else specs_from(suggest.suggest_checks(profile, per_table=per_table, limit=limit))
    evidence = suite.run_suite(spark, tables, chosen, as_of, timeout_seconds=timeout_seconds)
    at = F.lit(as_of).cast("timestamp")
    executions = suite.execution_records(evidence, suite.spec_frame(spark, chosen), run_id, as_of)
    findings = (
        rules.findings(evidence, rules.bands(spark))
        .withColumn("run_id", F.lit(run_id))
        .withColumn("created_at", at)
    )
    if understandings is None:
        understandings = spark.createDataFrame(
            [(run_id, t, None, False) for t in tables],
            "run_id string, table_id string, business_description string, parsing_failed boolean",
        )
    lines = report.report_lines(findings, understandings)
    rollup = severity_rollup(findings)
    if store is not None:
        append_log(executions, f"{store}/executions")
        append_log(findings, f"{store}/findings")
        append_log(rollup.withColumn("generated_at", at), f"{store}/reports")
        append_log(lines, f"{store}/report_lines")
    return RunResult(profile, chosen, executions, findings, lines, rollup)
