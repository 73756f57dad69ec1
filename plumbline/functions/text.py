"""Text rules as native column expressions: query audit, JSON salvage, elision, id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ColumnLike, column

# They decide which texts pass and must equal the published rules.
FORBIDDEN_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "GRANT", "REVOKE", "TRUNCATE", "MERGE", "REPLACE",
)
READ_VERBS = ("SELECT", "WITH", "DESCRIBE", "DESC", "SHOW", "EXPLAIN")
LIMITED_VERBS = ("SELECT", "WITH")
DEFENSIVE_LIMIT = 1000
REASON_FORBIDDEN = "contains forbidden DDL/DML keyword"
REASON_NOT_READ = "not a SELECT/WITH/DESCRIBE/SHOW/EXPLAIN"
ELIDE_OVER, ELIDE_KEEP = 30000, 15000
ELIDE_MARK = "\n\n... (middle elided for length) ...\n\n"

# The characters str.strip removes, for the regex engine of the JVM.
_SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FORBIDDEN = r"(?i)\b(" + "|".join(FORBIDDEN_WORDS) + r")\b"
_READ = r"(?i)\A" + _SPACE + r"*(" + "|".join(READ_VERBS) + r")\b"
# strict mode: literals and comments are no SQL words.
# No alternation is repeated per character: the JVM's engine recurses there and long texts overflow its stack.
_LITERALS = r"(?s)'[^']*+(?:''[^']*+)*+'|\"[^\"]*+(?:\"\"[^\"]*+)*+\"|--[^\n]*+|/\*.*?\*/"


def strip(value: ColumnLike) -> Column:
    return F.regexp_replace(column(value), rf"\A{_SPACE}+|{_SPACE}+\z", "")


def strip_end(value: ColumnLike) -> Column:
    return F.regexp_replace(column(value), rf"{_SPACE}+\z", "")


def sql_audit(df: DataFrame, sql: str = "sql", strict: bool = False) -> DataFrame:
    """Add ``ok``, ``reason`` and ``cleaned`` to a table of SQL texts.

    A forbidden word anywhere in the text rejects it, then a start that is not
    a read verb.  What passes loses closing semicolons and, for SELECT and
    WITH, gains a LIMIT when the text contains no "limit" at all.

    ``strict`` ignores words inside literals and comments, accepts a leading
    comment or bracket, treats "limit" as a word, and puts the LIMIT on its own
    line so that a trailing comment cannot swallow it.
    """
    text = F.coalesce(F.col(sql), F.lit(""))
    if strict:
        bare = F.regexp_replace(text, _LITERALS, " ")
        head = F.regexp_replace(bare, rf"\A[{_SPACE}(]++", "")
        trimmed = F.regexp_replace(text, rf"(?<![{_SPACE};])[{_SPACE};]++\z", "")
        limited = bare.rlike(r"(?i)\blimit\b")
        joint = "\nLIMIT "
    else:
        bare, head = text, text
        trimmed = strip_end(F.regexp_replace(text, r";+\z", ""))
        limited = F.lower(trimmed).contains("limit")
        joint = " LIMIT "
    verb = F.upper(F.regexp_extract(head, _READ, 1))
    forbidden = bare.rlike(_FORBIDDEN)
    not_read = verb == ""
    reason = F.when(forbidden, REASON_FORBIDDEN).when(not_read, REASON_NOT_READ)
    needs_limit = verb.isin(*LIMITED_VERBS) & ~limited
    cleaned = F.when(needs_limit, F.concat(trimmed, F.lit(f"{joint}{DEFENSIVE_LIMIT}"))).otherwise(trimmed)
    return (
        df.withColumn("ok", ~(forbidden | not_read))
        .withColumn("reason", reason)
        .withColumn("cleaned", F.when(F.col("ok"), cleaned))
    )


def strip_fence(value: ColumnLike) -> Column:
    """Remove a surrounding Markdown fence."""
    text = strip(value)
    opened = F.regexp_replace(text, r"\A[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"```\z", "")
    return F.when(text.startswith("```"), strip(closed)).otherwise(text)


def with_whole_json(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the text as a variant when all of it is one JSON value, else null.

    The parser stops after the first value and would accept text behind it, so
    the text is read as the only item of a list.  Text behind the value can
    escape the list only by closing it; where there is a closing bracket, the
    text must be readable inside ``{"v":...}`` as well, which would take a
    closing brace at the same place.

    Text and list are columns of their own, so each is computed once; a null
    text costs nothing.
    """
    staged = df.withColumn("_text", text)
    staged = staged.withColumn("_list", F.try_parse_json(F.concat(F.lit("["), "_text", F.lit("]"))))
    boxed = F.when(
        F.col("_text").contains("]"), F.try_parse_json(F.concat(F.lit('{"v":'), "_text", F.lit("}"))).isNotNull()
    ).otherwise(True)
    alone = F.try_variant_get("_list", "$[1]", "variant").isNull()
    return staged.withColumn(
        name, F.when(alone & boxed, F.try_variant_get("_list", "$[0]", "variant"))
    ).drop("_text", "_list")


def _between(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing character; null without both."""
    start = F.locate(opening, text)
    end = F.length(text) - F.locate(closing, F.reverse(text)) + 1
    return F.when((start > 0) & text.contains(closing) & (end > start), text.substr(start, end - start + 1))


def salvage_json(df: DataFrame, text: str, error_prefix: int = 200) -> DataFrame:
    """Read the JSON value out of chatty texts.

    Adds ``json`` (a variant), ``found`` (whole, object, array) and ``error``.
    Tried in turn: the text without its fence, from the first { to the last },
    from the first [ to the last ].
    """
    raw = F.col("_raw")
    staged = with_whole_json(df.withColumn("_raw", strip_fence(text)), raw, "_whole")
    # Later readings are tried only where the earlier ones failed.
    failed = F.col("_whole").isNull()
    staged = with_whole_json(staged, F.when(failed, _between(raw, "{", "}")), "_object")
    failed = failed & F.col("_object").isNull()
    staged = with_whole_json(staged, F.when(failed, _between(raw, "[", "]")), "_array")
    found = (
        F.when(F.col("_whole").isNotNull(), "whole")
        .when(F.col("_object").isNotNull(), "object")
        .when(F.col("_array").isNotNull(), "array")
    )
    error = F.concat(F.lit("Could not parse JSON from model output: "), F.substring("_raw", 1, error_prefix))
    return (
        staged.withColumn("json", F.coalesce("_whole", "_object", "_array"))
        .withColumn("found", found)
        .withColumn("error", F.when(F.col("found").isNull(), error))
        .drop("_raw", "_whole", "_object", "_array")
    )


def elide(value: ColumnLike, over: int = ELIDE_OVER, keep: int = ELIDE_KEEP) -> Column:
    """Keep head and tail of a text longer than ``over`` characters."""
    text = column(value)
    short = F.concat(F.substring(text, 1, keep), F.lit(ELIDE_MARK), F.right(text, F.lit(keep)))
    return F.when(F.length(text) > over, short).otherwise(text)


def explode_ids(df: DataFrame, ids: str) -> DataFrame:
    """One row per table id of a list separated by commas, semicolons or white space.

    Adds ``position`` (from 0), ``table_id`` and ``short_name``, its last dotted part.
    """
    items = F.filter(F.split(F.col(ids), rf"[{_SPACE},;]++"), lambda x: x != "")
    return df.select("*", F.posexplode(items).alias("position", "table_id")).withColumn(
        "short_name", F.element_at(F.split("table_id", r"\."), -1)
    )
