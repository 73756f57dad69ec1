"""Table memory: storing understandings with versions and vectors, and finding similar ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import EmbedBatch, embed, hashed_words, query_texts, understanding_texts
from .runs import skipped, usable
from .similarity import vector_topk
from .versions import assign_versions


def remember(
    incoming: DataFrame, stored: DataFrame, load: Callable[[], EmbedBatch] = lambda: hashed_words,
) -> DataFrame:
    """New understandings ready to append: numbered per table, usable ones with a vector.

    ``incoming`` has run_id, table_id, business_description, parsing_failed and
    updated_at; (updated_at, run_id) orders the versions of a table.  ``stored``
    is (table_id, version).
    """
    numbered = assign_versions(incoming, stored, ["updated_at", "run_id"])
    embedded = embed(understanding_texts(usable(numbered)), "embedding_text", load).drop("embedding_text")
    return embedded.unionByName(skipped(numbered), allowMissingColumns=True)


def prior_understandings(
    table_ids: DataFrame, understandings: DataFrame, load: Callable[[], EmbedBatch] = lambda: hashed_words,
    k: int = 3,
) -> DataFrame:
    """The k stored understandings most like each table, without their vectors.

    Several versions of one table may come back.  A table whose text could not
    be embedded gets one row with a ``warning`` and no match.
    """
    asked = embed(query_texts(table_ids), "embedding_text", load)
    known = understandings.where(F.col("embedding").isNotNull()).withColumn(
        "_id", F.concat_ws("@", "table_id", F.col("version").cast("string"))
    )
    nearest = vector_topk(
        asked.where(F.col("embedding").isNotNull()), known, query_id="table_id", query_vector="embedding",
        corpus_id="_id", corpus_vector="embedding", k=k,
    )
    found = nearest.select(F.col("query_id").alias("asked_table_id"), F.col("match_id").alias("_id"), "rank").join(
        known.drop("embedding"), "_id"
    ).drop("_id")
    warnings = asked.where(F.col("embedding_error").isNotNull()).select(
        F.col("table_id").alias("asked_table_id"),
        F.concat(F.lit("vector search unavailable: "), "embedding_error").alias("warning"),
    )
    return found.unionByName(warnings, allowMissingColumns=True)
