"""The dealt operators bound to the benchmark tables, each with the SQL it must agree with, if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_folder

from . import divergence, exact_dedup, hash_tree, license_search, mixing, near_dedup, nearest, packing, periodic_runs, quality, sanitise, secret_ledger, token_store
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("lane0"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return secret_ledger.digests(secret_ledger.scan(versions, shared_folder(spark, "llm-ledger")))


@query()
def op3_license_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_search.scan(table(spark, sf_dir, "documents"))
    parts = F.transform("spans", lambda s: F.concat_ws(":", s["label"], *[s[c].cast("string") for c in ("first", "last", "edits")]))
    return found.withColumn("spans", F.array_join(parts, ","))


@query("""
WITH flat AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM flat
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZER)


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("copies")


@query()
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 20 = 0")).drop("verified")


@query()
def op9_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(sanitise.scan(table(spark, sf_dir, "documents")))


@query()
def op10_wavelet_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encoded(table(spark, sf_dir, "documents"), TOKENIZER)


def _mixed_sql(name: str, start: str) -> str:
    """Columns that end with ``name``, the mixed 32 bits of ``start``."""
    f = hash_tree.FACTOR
    return (
        f"{start} AS {name}0, (xor({name}0, {name}0 >> 16) * {f}) & 4294967295 AS {name}1, "
        f"(xor({name}1, {name}1 >> 16) * {f}) & 4294967295 AS {name}2, xor({name}2, {name}2 >> 16) AS {name}"
    )


@query(f"""
WITH steps AS (
    -- CRC-32 of a byte, by its 8 bits
    SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
), docs AS (
    SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents
), sized AS (
    SELECT doc_id, n, strlen(text) + 1 AS size,
           xor(list_reduce(list_prepend(4294967295, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(text)), '..')]),
               lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM docs, steps
), high AS (
    SELECT *, {_mixed_sql("h", "(coalesce(doc_id, -1) >> 32) & 4294967295")} FROM sized
), hashed AS (
    SELECT *, {_mixed_sql("k", "xor(h, coalesce(doc_id, -1) & 4294967295)")} FROM high
), leaves AS (
    SELECT s AS leaf, {_mixed_sql("m", "s + 1")} FROM range(17) t(s)
), drawn AS (
    SELECT doc_id, n, size, text_crc32, leaf, {_mixed_sql("d", "xor(k, m)")} FROM hashed, leaves
), chosen AS (
    SELECT doc_id, n, size, text_crc32,
           first(leaf ORDER BY d DESC, leaf) FILTER (leaf < 16) AS shard, first(leaf ORDER BY d DESC, leaf) AS grown_shard
    FROM drawn GROUP BY ALL
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot,
       grown_shard::INT AS grown_shard
FROM chosen
""")
def op11_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return hash_tree.assignment(documents, hash_tree.tree(16), hash_tree.tree(17))


@query(r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), terms AS (
    SELECT id, lang, source,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), kept AS (
    SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), counted AS (
    SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), filled AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), grouped AS (
    SELECT lang, source, term, n,
           1 + ((n + 2)::HUGEINT * 1000000000) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
    FROM filled
), whole AS (
    SELECT lang, term, 1 + ((n + 2)::HUGEINT * 1000000000) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
    FROM kept
), sources AS (
    SELECT DISTINCT lang, source FROM docs
), compared AS (
    SELECT lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM grouped a JOIN grouped b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(c.value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM grouped JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, place::INT AS rank FROM ranked WHERE part = 'pair' OR place <= 10
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = periodic_runs.planted(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.detect(documents))
