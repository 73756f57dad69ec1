"""Fixed schemas of the run artefacts, as DDL, and the enumerations they use."""

from __future__ import annotations

RUNS = (
    "run_id string, pipeline_path string, source_tables array<string>,"
    " destination_tables array<string>, business_context_seed string, status string,"
    " current_node string, run_source string, stop_requested boolean, created_at timestamp,"
    " started_at timestamp, updated_at timestamp, completed_at timestamp, stopped_at timestamp,"
    " error string"
)
QUESTIONS = (
    "run_id string, question_id string, table_id string, question string,"
    " why_it_matters string, created_at timestamp"
)
ANSWERS = (
    "run_id string, question_id string, table_id string, question string, answer string,"
    " answered_at timestamp, source string"
)
EXECUTIONS = (
    "run_id string, query_id string, check_name string, purpose string, category string,"
    " target_table string, sql string, status string, runtime_ms bigint, row_count bigint,"
    " result_sample array<map<string,string>>, error string, executed_at timestamp"
)
FINDINGS = (
    "run_id string, title string, severity string, evidence string, recommended_action string,"
    " related_check string, related_table string, created_at timestamp"
)
REPORTS = (
    "run_id string, markdown string, severity_summary struct<pass:bigint,warn:bigint,fail:bigint>,"
    " generated_at timestamp"
)
UNDERSTANDINGS = (
    "run_id string, table_id string, version bigint, business_description string,"
    " grain struct<columns:array<string>,confidence:string,evidence:array<string>>,"
    " freshness_expectation struct<cadence:string,expected_lag:string,confidence:string,source:string>,"
    " important_columns array<struct<name:string,role:string,nullable_expected:boolean,"
    "confidence:string,evidence:array<string>>>,"
    " known_risks array<string>, source_evidence array<struct<type:string,content:string>>,"
    " embedding array<float>, parsing_failed boolean, parse_error string, embedding_error string,"
    " updated_at timestamp"
)
COLUMN_METADATA = (
    "table_id string, database string, name string, location string, ordinal int, column string,"
    " type string, comment string, is_partition boolean, table_type string, input_format string,"
    " error string"
)
CHECK_SPECS = (
    "id string, name string, intent string, target_table string, sql string, risk_level string,"
    " expected_outcome string, category string"
)

# The enumerations of the published data contract.
CATEGORIES = (
    "schema", "freshness", "row_count", "null_check", "duplicate_grain",
    "reconciliation", "aggregation_sanity", "business_rule",
)
SEVERITIES = ("pass", "warn", "fail")
RISK_LEVELS = ("low", "medium", "high")
EXECUTION_STATUSES = ("ok", "rejected", "timeout", "failed", "skipped")
RUN_STATUSES = (
    "submitted", "pending", "running", "awaiting_user", "stopping", "stopped", "complete", "failed",
)
