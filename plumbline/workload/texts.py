"""Text rules, embeddings and similarity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as rules
from ..operators import embedding, similarity, vector_index
from ..session import shared_folder
from . import query, table

# One SQL text per event, in the shapes that tell the rules apart.
_LOG_SQL = """CASE event_id % 12
    WHEN 0 THEN concat('SELECT * FROM t WHERE k = ', user_id)
    WHEN 1 THEN concat('  select count(*) from t', user_id, ' LIMIT 5;')
    WHEN 2 THEN concat('DELETE FROM t WHERE k = ', user_id)
    WHEN 3 THEN concat('WITH x AS (SELECT 1) SELECT * FROM x;; ')
    WHEN 4 THEN concat('SELECT credit_limit FROM t', user_id, ';;')
    WHEN 5 THEN concat('SELECT replace(a, b, c) FROM t', user_id)
    WHEN 6 THEN concat('SELECT updated_at FROM t', user_id, ' -- newest')
    WHEN 7 THEN concat('(SELECT 1 FROM t', user_id, ')')
    WHEN 8 THEN concat('DESCRIBE t', user_id, '  ')
    WHEN 9 THEN concat('-- note', chr(10), 'SELECT 1 FROM t', user_id)
    WHEN 10 THEN concat('SELECT ', chr(39), 'please drop it', chr(39), ' FROM ', event_type)
    ELSE concat('SELECTED ', event_type) END"""


@query(f"""
    WITH log AS (SELECT event_id, {_LOG_SQL} AS sql FROM events),
    j AS (SELECT *, regexp_matches(sql, '(?i)\\b({"|".join(rules.FORBIDDEN_WORDS)})\\b') AS bad,
                 upper(regexp_extract(sql, '(?i)^\\s*({"|".join(rules.READ_VERBS)})\\b', 1)) AS verb,
                 regexp_replace(regexp_replace(sql, ';+$', ''), '\\s+$', '') AS cut FROM log)
    SELECT event_id, NOT bad AND verb <> '' AS ok,
           CASE WHEN bad THEN '{rules.REASON_FORBIDDEN}' WHEN verb = '' THEN '{rules.REASON_NOT_READ}' ELSE '' END AS reason,
           CASE WHEN bad OR verb = '' THEN '' WHEN verb IN ('SELECT', 'WITH') AND NOT contains(lower(cut), 'limit')
                THEN concat(cut, ' LIMIT 1000') ELSE cut END AS cleaned
    FROM j
""")
def sql_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", F.expr(_LOG_SQL).alias("sql"))
    return rules.sql_audit(log).drop("sql").na.fill("")


_RESPONSE_SQL = """CASE event_id % 10
    WHEN 0 THEN props
    WHEN 1 THEN concat(chr(96), chr(96), chr(96), 'json', chr(10), props, chr(10), chr(96), chr(96), chr(96))
    WHEN 2 THEN concat('Here you are: ', props, ' Anything else?')
    WHEN 3 THEN concat('[', props, ', ', event_id, ']')
    WHEN 4 THEN concat('The list is [', event_id, ', 2] as asked')
    WHEN 5 THEN concat('nothing for ', event_type)
    WHEN 6 THEN concat(props, ' and ', props)
    WHEN 7 THEN concat(props, ' and }')
    WHEN 8 THEN concat('} before {', event_id)
    ELSE concat('  ', event_id, '  ') END"""


@query(f"""
    WITH r AS (SELECT event_id, {_RESPONSE_SQL} AS t FROM events),
    f AS (SELECT event_id, CASE WHEN starts_with(trim(t), '```') THEN
              trim(regexp_replace(regexp_replace(trim(t), '^[^\\n]*\\n', ''), '```$', ''), chr(10) || ' ') ELSE trim(t) END AS t FROM r),
    p AS (SELECT event_id, t, strpos(t, '{{') AS os, length(t) - strpos(reverse(t), '}}') + 1 AS oe,
                 strpos(t, '[') AS a1, length(t) - strpos(reverse(t), ']') + 1 AS ae FROM f),
    c AS (SELECT event_id, t,
                 CASE WHEN os > 0 AND contains(t, '}}') AND oe > os THEN substr(t, os, oe - os + 1) END AS o,
                 CASE WHEN a1 > 0 AND contains(t, ']') AND ae > a1 THEN substr(t, a1, ae - a1 + 1) END AS a FROM p),
    v AS (SELECT event_id, t, CASE WHEN json_valid(t) THEN t END AS w, CASE WHEN json_valid(o) THEN o END AS o,
                 CASE WHEN json_valid(a) THEN a END AS a FROM c)
    SELECT event_id, CASE WHEN w IS NOT NULL THEN 'whole' WHEN o IS NOT NULL THEN 'object' WHEN a IS NOT NULL THEN 'array'
                     ELSE '' END AS found,
           coalesce(CAST(json(coalesce(w, o, a)) AS VARCHAR), '') AS json,
           CASE WHEN coalesce(w, o, a) IS NULL THEN concat('Could not parse JSON from model output: ', left(t, 200))
                ELSE '' END AS error
    FROM v
""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = table(spark, sf_dir, "events").select("event_id", F.expr(_RESPONSE_SQL).alias("response"))
    return (
        rules.salvage_json(responses, "response")
        .withColumn("json", F.to_json("json"))
        .drop("response")
        .na.fill("")
    )


def _elided_sql(over: int, keep: int) -> str:
    mark = "concat(chr(10), chr(10), '... (middle elided for length) ...', chr(10), chr(10))"
    return (
        f"CASE WHEN length(text) > {over} THEN concat(substr(text, 1, {keep}), {mark}, right(text, {keep})) ELSE text END"
    )


@query(f"""
    SELECT doc_id, length({_elided_sql(30000, 15000)}) AS n_chars, md5({_elided_sql(30000, 15000)}) AS elided,
           length({_elided_sql(2000, 1000)}) AS n_chars_short, md5({_elided_sql(2000, 1000)}) AS elided_short
    FROM documents
""")
def elide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    usual, short = rules.elide("text"), rules.elide("text", 2000, 1000)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(usual).cast("bigint").alias("n_chars"), F.md5(usual.cast("binary")).alias("elided"),
        F.length(short).cast("bigint").alias("n_chars_short"), F.md5(short.cast("binary")).alias("elided_short"),
    )


_ID_LIST_SQL = """concat(' raw.', event_type, '.tbl', user_id, ', ', event_type, ';silver.t', event_id, chr(10), chr(9),
    CASE WHEN event_type = 'view' THEN '' ELSE 'gold.peak' END, ' ;')"""


@query(f"""
    WITH l AS (SELECT event_id, regexp_split_to_array({_ID_LIST_SQL}, '[\\s,;]+') AS parts FROM events),
    x AS (SELECT event_id, list_filter(parts, lambda p: p <> '') AS ids FROM l),
    e AS (SELECT event_id, unnest(ids) AS table_id, generate_subscripts(ids, 1) - 1 AS position FROM x)
    SELECT event_id, CAST(position AS INT) AS position, table_id, split_part(table_id, '.', -1) AS short_name FROM e
""")
def explode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "events").select("event_id", F.expr(_ID_LIST_SQL).alias("ids"))
    return rules.explode_ids(lists, "ids").drop("ids")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TOO_LONG = 4000


def _letter_counts() -> embedding.EmbedBatch:
    """How often a text has each letter; a text that is too long fails its whole batch."""
    def run(texts):
        if any(len(t) > _TOO_LONG for t in texts):
            raise ValueError(f"longer than {_TOO_LONG} characters")
        return [[t.count(c) + t.count(c.upper()) for c in _LETTERS] for t in texts]

    return run


@query(f"""
    SELECT doc_id, length(text) <= {_TOO_LONG} AS made, CASE WHEN length(text) <= {_TOO_LONG} THEN 26 ELSE -1 END AS dims,
           CASE WHEN length(text) <= {_TOO_LONG} THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE -1 END AS letters,
           CASE WHEN length(text) <= {_TOO_LONG} THEN length(regexp_replace(text, '[^Ee]', '', 'g')) ELSE -1 END AS e,
           CASE WHEN length(text) > {_TOO_LONG} THEN 'longer than {_TOO_LONG} characters' ELSE '' END AS error
    FROM documents
""")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of letter counts for every document; documents that fail a batch stand alone in the end."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = embedding.embed(documents, "text", _letter_counts)
    known = F.col("embedding").isNotNull()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select(
        "doc_id", known.alias("made"), F.when(known, F.size("embedding")).otherwise(-1).alias("dims"),
        F.when(known, total).otherwise(-1).cast("long").alias("letters"),
        F.when(known, F.element_at("embedding", 5)).otherwise(-1).cast("long").alias("e"),
        F.coalesce("embedding_error", F.lit("")).alias("error"),
    )


@query("SELECT doc_id, 1024 AS dims, 1.0::DOUBLE AS length FROM documents")
def embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag-of-words vectors of every document, without Python workers."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = embedding.hashed_features(documents, "text")
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dims"), F.round(length, 4).alias("length"))


_COSINE = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


def _six(column: str) -> Column:
    """Six digits, rounded on the double as SQL engines do; Spark's round goes by the printed number and differs on halves."""
    value = F.col(column)
    return F.signum(value) * F.floor(F.abs(value) * 1e6 + 0.5) / 1e6


def _centres(embeddings: DataFrame) -> DataFrame:
    """The mean vector of every label; a label has as many rows here as a vector has numbers."""
    numbers = embeddings.select("label", F.posexplode("embedding").alias("at", "x"))
    means = numbers.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre")
    )


@query(f"""
    WITH n AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    m AS (SELECT label, pos, avg(x) AS x FROM n GROUP BY 1, 2),
    c AS (SELECT label, list(x ORDER BY pos) AS centre FROM m GROUP BY 1),
    s AS (SELECT c.label AS query_id, e.vec_id AS match_id, {_COSINE.format(a='c.centre', b='e.embedding')} AS similarity
          FROM c CROSS JOIN embeddings e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, match_id) AS "rank" FROM s)
    SELECT query_id, match_id, round(similarity, 6) AS similarity, CAST("rank" AS INT) AS "rank" FROM r WHERE "rank" <= 3
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few queries, one scan: the vectors nearest to the centre of each label."""
    embeddings = table(spark, sf_dir, "embeddings")
    found = similarity.vector_topk(
        _centres(embeddings), embeddings, query_id="label", query_vector="centre", corpus_id="vec_id",
        corpus_vector="embedding",
    )
    return found.withColumn("similarity", _six("similarity"))


@query(f"""
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id,
                      {_COSINE.format(a='q.embedding', b='e.embedding')} AS similarity
               FROM embeddings q CROSS JOIN embeddings e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, match_id) AS "rank" FROM s)
    SELECT query_id, match_id, round(similarity, 6) AS similarity, CAST("rank" AS INT) AS "rank" FROM r WHERE "rank" <= 3
""")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks: the plan by cells, whatever the number of vectors."""
    embeddings = table(spark, sf_dir, "embeddings")
    found = similarity.vector_topk(
        embeddings, embeddings, query_id="vec_id", query_vector="embedding", corpus_id="vec_id",
        corpus_vector="embedding", max_inline=0,
    )
    return found.withColumn("similarity", _six("similarity"))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    embeddings = table(spark, sf_dir, "embeddings")
    path = shared_folder(spark, "vector-index")
    vector_index.build(embeddings, path, corpus_id="vec_id", corpus_vector="embedding")
    return embeddings, path


_USABLE_SQL = "embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0"


@query(f"""
    SELECT count(*) FILTER (vec_id % 10 = 0) AS queries, 3 * count(*) FILTER (vec_id % 10 = 0) AS expected,
           true AS recall_reached, true AS share_kept
    FROM embeddings WHERE {_USABLE_SQL}
""")
def vector_topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of every tenth vector by the index, held against the exact ones: recall of 0.9 within a fifth of the pairs."""
    embeddings, path = _indexed(spark, sf_dir)
    asked = embeddings.where("vec_id % 10 = 0")
    near = vector_index.search(asked, path, query_id="vec_id", query_vector="embedding").select("query_id", "match_id")
    exact = similarity.vector_topk(
        asked, embeddings, query_id="vec_id", query_vector="embedding", corpus_id="vec_id", corpus_vector="embedding",
    ).where("similarity is not null").select("query_id", "match_id")
    both = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "match_id"], "left").agg(
        F.count("*").alias("expected"), F.count("hit").alias("hits")
    )
    spent = vector_index.cost(asked, path, query_id="vec_id", query_vector="embedding").first()
    return both.select(
        F.lit(spent["queries"]).cast("long").alias("queries"), "expected", (F.col("hits") >= 0.9 * F.col("expected")).alias("recall_reached"),
        F.lit(spent["share"] <= 0.2).alias("share_kept"),
    )


@query(f"""
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id, {_COSINE.format(a='q.embedding', b='e.embedding')} AS similarity
               FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 25 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, match_id) AS "rank" FROM s)
    SELECT query_id, match_id, round(similarity, 6) AS similarity, CAST("rank" AS INT) AS "rank" FROM r WHERE "rank" <= 3
""")
def vector_index_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with every cell probed: codes choose the candidates of all rows, and the result is exact."""
    embeddings, path = _indexed(spark, sf_dir)
    found = vector_index.search(
        embeddings.where("vec_id % 25 = 0"), path, query_id="vec_id", query_vector="embedding", probes=vector_index.MAX_CELLS,
    )
    return found.withColumn("similarity", _six("similarity"))
