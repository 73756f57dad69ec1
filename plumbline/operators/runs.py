"""Reads over the run history: lists, open questions, snapshots, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_all
from ..functions.ordering import chunked_text, split_previous
from ..schemas import SEVERITIES

MAX_PAGE = 50  # fixed value: the largest page of the run list


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows where every named column equals the value; null asks for null."""
    for name, value in values.items():
        df = df.where(F.col(name).eqNullSafe(F.lit(value)))
    return df


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Drop bulky columns; names the table lacks are ignored."""
    return df.drop(*columns)


def semi_in(df: DataFrame, column: str, members: DataFrame | Sequence[object]) -> DataFrame:
    """Membership in a list or in the first column of a frame."""
    if not isinstance(members, DataFrame):
        return df.where(F.col(column).isin(list(members)))
    return df.join(members.toDF(column), column, "left_semi")


def usable(df: DataFrame) -> DataFrame:
    """Understandings that parsed; a missing flag counts as parsed."""
    return df.where(~F.coalesce(F.col("parsing_failed"), F.lit(False)))


def skipped(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("parsing_failed"), F.lit(False)))


def for_daemon(runs: DataFrame, owned_elsewhere: str = "webapp") -> DataFrame:
    """Runs this side has to pick up: they have an id and no other owner."""
    return runs.where(
        ~F.col("run_source").eqNullSafe(F.lit(owned_elsewhere)) & F.col("run_id").isNotNull()
        & (F.col("run_id").cast("string") != "")
    )


def with_question_id(questions: DataFrame) -> DataFrame:
    """Ids from what is asked, so that asking again after an interruption adds nothing new.

    ``questions`` has run_id, round, table_id and question.
    """
    asked = F.to_json(F.struct("run_id", "table_id", "question", "round"))
    return questions.withColumn("question_id", F.sha2(asked, 256))


def unanswered(questions: DataFrame, answers: DataFrame, key: Sequence[str] = ("run_id", "question_id")) -> DataFrame:
    """Pending questions without an answer.  Sort by ``created_at`` to show them."""
    return questions.join(answers.select(*key), list(key), "left_anti")


def findings_by_check(
    executions: DataFrame, findings: DataFrame, order: Sequence[str], chunk_size: int = 1000
) -> DataFrame:
    """Executions with the titles of their findings, joined with "; ".

    A finding belongs to the check whose id it names; failing that, to the one
    whose name it gives.  ``matched_by`` tells which.  A check without findings
    keeps one row with null titles; one with more than ``chunk_size`` findings
    has several rows.
    """
    checks = executions.select("run_id", "query_id", "check_name", "status")
    named = findings.select(
        "run_id", F.col("related_check").alias("_ref"),
        F.coalesce("title", F.lit("Untitled finding")).alias("_title"), *order,
    )
    # Titles are gathered per reference, before any join: a check is looked up
    # once per reference and not once per finding.
    gathered = chunked_text(
        named.where(F.col("_ref").isNotNull()), ["run_id", "_ref"], "_title", order,
        chunk_size=chunk_size, name="supports",
    )
    # A reference means the check with that id; only if there is none, those of that name.
    by_id = checks.select("run_id", F.col("query_id").alias("_ref"), "query_id").distinct()
    by_name = checks.select("run_id", F.col("check_name").alias("_ref"), "query_id").distinct()
    links = by_id.withColumn("_how", F.lit("id")).unionAll(
        by_name.join(by_id, ["run_id", "_ref"], "left_anti").withColumn("_how", F.lit("name"))
    )
    attached = links.join(gathered, ["run_id", "_ref"])
    return checks.join(attached, ["run_id", "query_id"], "left").select(
        "run_id", "query_id", "check_name", "status",
        F.col("_how").alias("matched_by"),
        F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk"),
        F.coalesce("n_texts", F.lit(0).cast("bigint")).alias("n_findings"), "supports",
    )


def severity_rollup(findings: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Findings that are exactly pass, warn or fail, always as three counts."""
    return findings.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def run_list(runs: DataFrame, rollups: DataFrame, limit: int = 20) -> DataFrame:
    """The most recent runs with their rollup, zeros where a run has no report.

    ``rollups`` is (run_id, pass, warn, fail) with one row per run.  The page is
    cut first, so only its at most 50 ids are broadcast against the rollups,
    and only the at most 50 rollups found against the page.
    """
    size = max(1, min(limit, MAX_PAGE))
    page = runs.orderBy(
        F.col("started_at").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("run_id")
    ).limit(size)
    ids = page.select("run_id")
    found = rollups.join(F.broadcast(ids), "run_id", "left_semi")
    return page.join(F.broadcast(found), "run_id", "left").select(
        *page.columns, *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in SEVERITIES]
    )


def answers_complete(
    questions: DataFrame, answers: DataFrame, answer_key: Sequence[str] = ("run_id", "round", "question_id"),
    salt_above: int = 100_000,
) -> DataFrame:
    """Answers of the rounds in which every question has one, with the question's wording.

    ``questions``: run_id, round, question_id, n_questions, table_id, question, asked_at.
    ``answers``: ``answer_key`` and answer; one row per question (see
    :func:`plumbline.sources.logs.last_write`).  Unknown ids never count.
    """
    key = ["run_id", "round", "question_id"]
    # By all three keys: a run with very many questions must not stay in one partition.
    asked = questions.repartition(*key).dropDuplicates(key)
    matched = asked.join(answers.select(*answer_key, "answer"), list(answer_key))
    # Every question knows the size of its round: large rounds are salted, small ones are not.
    parts = F.ceil(F.col("n_questions") / F.lit(salt_above)).cast("int")
    complete = (
        matched.groupBy("run_id", "round")
        .agg(count_all().alias("_answered"), F.max("n_questions").alias("n_questions"))
        .where(F.col("_answered") >= F.col("n_questions"))
        .select("run_id", "round", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_salt"))
    )
    salted = matched.withColumn("_salt", F.pmod(F.xxhash64("question_id"), parts).cast("int"))
    return salted.join(complete, ["run_id", "round", "_salt"], "left_semi").select(
        *key, "table_id", "question", "answer", "asked_at"
    )


def validate_answers(pending: DataFrame, provided: DataFrame) -> DataFrame:
    """One verdict per run on a batch of answers, before anything is stored.

    ``pending`` and ``provided`` share run_id and question_id; an id may occur
    once in each.  Ids that are not pending are ignored.
    """
    key = ["run_id", "question_id"]
    checked = pending.select(*key).join(
        provided.select(*key, F.trim(F.coalesce("answer", F.lit(""))).alias("_text"), F.lit(True).alias("_given")),
        key, "left",
    )
    counts = checked.groupBy("run_id").agg(
        count_all().alias("pending"),
        F.count_if(F.col("_given").isNull()).alias("missing"),
        F.count_if(F.col("_given") & (F.col("_text") == "")).alias("blank"),
    )
    return counts.withColumn(
        "verdict",
        F.when(F.col("missing") > 0, "missing_answers").when(F.col("blank") > 0, "blank_answer").otherwise("accepted"),
    )


def run_counts(
    runs: DataFrame, questions: DataFrame, answers: DataFrame, executions: DataFrame, findings: DataFrame,
    rollups: DataFrame | None = None,
) -> DataFrame:
    """Per run: open and answered questions, executions, findings and the rollup.

    Every log is reduced to partial counts and the counts are added up in one
    grouping, so no log is joined with another and a hot run is no hot task.
    ``rollups`` (run_id, pass, warn, fail) adds the report's severity counts.
    """
    names = ("known", "pending_questions", "answered_questions", "executed_queries", "findings", *SEVERITIES)

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("run_id", *[given.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    one = F.lit(1)
    parts = [
        part(runs, known=one),
        part(unanswered(questions, answers, ["run_id", "question_id"]), pending_questions=one),
        part(answers, answered_questions=one),
        part(executions, executed_queries=one),
        part(findings, findings=one),
    ]
    if rollups is not None:
        parts.append(part(rollups, **{s: F.col(s) for s in SEVERITIES}))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionAll(p)
    summed = total.groupBy("run_id").agg(*[F.sum(n).alias(n) for n in names])
    return summed.where(F.col("known") > 0).drop("known")


def run_snapshot(
    run_id: object, *, runs: DataFrame, questions: DataFrame, answers: DataFrame, executions: DataFrame,
    findings: DataFrame, reports: DataFrame,
) -> Mapping[str, DataFrame]:
    """Everything stored about one run, each artefact as its own sorted frame.

    The id is filtered before anything else, which prunes partitions when the
    logs are partitioned by run.
    """
    def own(df: DataFrame) -> DataFrame:
        return df.where(F.col("run_id") == F.lit(run_id))

    asked, given, executed, found = own(questions), own(answers), own(executions), own(findings)
    report = own(reports)
    return {
        "run": own(runs),
        "pending_questions": unanswered(asked, given).orderBy("created_at"),
        "answered_questions": given.orderBy("answered_at"),
        "executed_queries": executed.orderBy("executed_at"),
        "findings": found.orderBy("created_at"),
        "report": report,
        "documents": report.select(
            F.lit("report_markdown").alias("kind"), F.lit("Final QA report").alias("title"), "generated_at"
        ),
        "summary": run_counts(own(runs), asked, given, executed, found, severity_rollup(found)),
    }


def status_key() -> Column:
    return F.concat_ws(":", F.coalesce("status", F.lit("unknown")), F.coalesce("current_node", F.lit("none")))


def status_changes(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows where ``status:current_node`` of a run differs from the row before."""
    keyed = events.withColumn("status_key", status_key())
    seen = split_previous(keyed, ["run_id"], order, F.col("status_key"), "_before")
    return seen.where(~F.col("status_key").eqNullSafe(F.col("_before"))).drop("_before")
