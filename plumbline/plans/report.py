"""Reports as frames of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_all, severity_rank
from ..operators.profile import union_all
from ..operators.runs import severity_rollup, skipped, usable

TITLE, SUMMARY, TABLES, SKIPPED, FINDINGS, ACTIONS = range(1, 7)


def report_lines(findings: DataFrame, understandings: DataFrame, at: str = "created_at") -> DataFrame:
    """(run_id, section, rank, at, line); sort by these columns to read a report.

    Findings come worst first, then by time.  Lines stay rows and carry what
    they sort by, so no task ever holds the lines of a whole run.
    """
    def section(df: DataFrame, number: int, line: Column, rank: Column | None = None, time: Column | None = None):
        return df.select(
            "run_id", F.lit(number).alias("section"), (F.lit(0) if rank is None else rank).alias("rank"),
            (F.lit(None) if time is None else time).cast("timestamp_ntz").alias("at"), line.alias("line"),
        )

    reviewed, left_out = usable(understandings), skipped(understandings)
    counted = reviewed.groupBy("run_id").agg(count_all().alias("tables"))
    totals = severity_rollup(findings).join(counted, "run_id", "full_outer").na.fill(0)
    worst = severity_rank("severity")
    advice = (
        findings.where(F.col("recommended_action").isNotNull() & (F.col("recommended_action") != "no action"))
        .groupBy("run_id", "recommended_action")
        .agg(F.min(worst).alias("_rank"))
    )
    dash = F.lit(" — ")
    summary = F.concat(
        F.lit("Reviewed "), F.col("tables"), F.lit(" tables. Severity summary: "), F.col("pass"), F.lit(" pass, "),
        F.col("warn"), F.lit(" warn, "), F.col("fail"), F.lit(" fail."),
    )
    heads = totals.select(
        "run_id",
        F.inline(F.array(
            F.struct(F.lit(TITLE).alias("section"), F.lit("# Data QA Report").alias("line")),
            F.struct(F.lit(SUMMARY).alias("section"), summary.alias("line")),
        )),
    ).select("run_id", "section", F.lit(0).alias("rank"), F.lit(None).cast("timestamp_ntz").alias("at"), "line")
    return union_all([
        heads,
        section(
            reviewed, TABLES,
            F.concat(F.lit("- **"), F.col("table_id"), F.lit("**"), dash, F.coalesce("business_description", F.lit(""))),
        ),
        section(left_out, SKIPPED, F.concat(F.lit("- not characterised: "), F.col("table_id"))),
        section(
            findings, FINDINGS,
            F.concat(
                F.lit("- ["), F.upper(F.coalesce("severity", F.lit("none"))), F.lit("] "),
                F.coalesce("title", F.lit("Untitled finding")), dash, F.coalesce("evidence", F.lit("")),
            ),
            worst, F.col(at),
        ),
        section(advice, ACTIONS, F.concat(F.lit("- "), F.col("recommended_action")), F.col("_rank")),
    ])


def report_summaries(findings: DataFrame) -> DataFrame:
    """The rollup stored beside a report: (run_id, severity_summary)."""
    return severity_rollup(findings).select("run_id", F.struct("pass", "warn", "fail").alias("severity_summary"))


def write_report(lines: DataFrame, run_id: object, path: str) -> None:
    """One run's report as text.  The order is kept across the part files."""
    own = lines.where(F.col("run_id") == F.lit(run_id))
    own.orderBy("section", "rank", "at", "line").select("line").write.mode("overwrite").text(path)
