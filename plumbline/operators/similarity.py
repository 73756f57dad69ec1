"""Top-k rows by cosine similarity, exact and approximate.

Scores are cosines in double precision, ranked after rounding to nine digits
so that equal vectors tie whatever the order of summation; ties go to the
smaller id.  A missing or zero vector has no score and ranks last.

Spark partitions and shuffles; numpy scores whole Arrow batches inside a task
and hands on only the best k per query, never the pairs.

Two exact plans:

* few queries: their vectors travel with the task, the corpus is read once and
  each task keeps a running top k;
* many queries: corpus rows go to the cell of their nearest pivot, neighbouring
  cells are packed into groups of about a block, a query goes once to each group
  with a cell that can hold one of its k nearest (triangle inequality), and
  groups larger than a block are split on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INLINE_QUERIES = 256
BLOCK_ROWS = 20_000
MAX_PIVOTS = 2048
# Groups a corpus smaller than that many blocks is cut into, rows a task holds
# against all pivots at a time, and scores it holds at a time.
LEAST_GROUPS = 16
STEP_ROWS = 512
STEP_SCORES = 2_000_000
_RANK_DIGITS = 9


def _matrix(vectors: pa.Array | pa.ChunkedArray | list, dims: int) -> np.ndarray:
    """Rows as doubles; a missing vector becomes a zero row."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if isinstance(vectors, pa.Array) and vectors.null_count == 0:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if flat.size == len(vectors) * dims:
            return flat.reshape(len(vectors), dims).astype(np.float64)
    rows = vectors.to_pylist() if isinstance(vectors, pa.Array) else list(vectors)
    out = np.zeros((len(rows), dims))
    for i, row in enumerate(rows):
        if row is not None:
            if len(row) != dims:
                raise ValueError(f"vector with {len(row)} values among vectors with {dims}")
            out[i] = row
    return out


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which of them have a length."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    known = norms > 0
    return rows / np.where(known, norms, 1.0)[:, None], known


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id; -inf stands for no score."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _scores(queries: np.ndarray, block: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = np.round(queries @ block.T, _RANK_DIGITS)
    out[:, ~known] = -np.inf
    return out


def _result_schema(queries: DataFrame, qid: str, corpus: DataFrame, cid: str) -> T.StructType:
    return (
        T.StructType()
        .add("query_id", queries.schema[qid].dataType)
        .add("match_id", corpus.schema[cid].dataType)
        .add("similarity", T.DoubleType())
    )


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    """Final top k; each query has at most k candidates per upstream task or block."""
    order = W.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), F.col("match_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_topk(
    queries: DataFrame, corpus: DataFrame, *, query_id: str, query_vector: str, corpus_id: str,
    corpus_vector: str, k: int = 3, max_inline: int = MAX_INLINE_QUERIES, block_rows: int = BLOCK_ROWS,
    pivots: int | None = None,
) -> DataFrame:
    """(query_id, match_id, similarity, rank) with the k most similar corpus rows per query.

    Fetches at most ``max_inline`` + 1 queries to choose the plan.  Without
    ``pivots``, the plan by cells takes the square root of the corpus size, at
    most 2048.
    """
    q = queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("vector"))
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vector).alias("vector"))
    schema = _result_schema(q, "id", c, "id")
    few = q.limit(max_inline + 1).collect()
    if len(few) <= max_inline:
        return _topk_inline(few, c, k, schema)
    return _topk_cells(q, c, k, schema, pivots, block_rows)


def _topk_inline(queries: list, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    ids = [r["id"] for r in queries]
    dims = next((len(r["vector"]) for r in queries if r["vector"] is not None), 0)
    units, has_length = _unit(_matrix([r["vector"] for r in queries], dims))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_ids: list[list] = [[] for _ in ids]
        top_scores: list[list] = [[] for _ in ids]
        for batch in batches:
            rows = _matrix(batch.column("vector"), dims) if dims else np.zeros((batch.num_rows, 0))
            block, known = _unit(rows)
            found = _scores(units, block, known)
            found[~has_length, :] = -np.inf
            block_ids = np.array(batch.column("id").to_pylist())
            for i in range(len(ids)):
                best = _best(found[i], block_ids, k)
                merged_ids = np.array(top_ids[i] + block_ids[best].tolist())
                merged = np.array(top_scores[i] + found[i][best].tolist())
                keep = _best(merged, merged_ids, k)
                top_ids[i], top_scores[i] = merged_ids[keep].tolist(), merged[keep].tolist()
        out_q = [q for q, found_ids in zip(ids, top_ids) for _ in found_ids]
        out_c = [c for found_ids in top_ids for c in found_ids]
        out_s = [None if s == -np.inf else s for row in top_scores for s in row]
        if out_q:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q), pa.array(out_c), pa.array(out_s, pa.float64())],
                names=["query_id", "match_id", "similarity"],
            ).cast(_arrow_schema(schema))

    return _ranked(corpus.mapInArrow(scan, schema), k)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _groups(centres: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of every cell: cells in a chain of near centres, cut where a group would hold more than ``most`` rows."""
    group, at, held = np.zeros(len(sizes), dtype=np.int32), 0, 0
    left, number = np.ones(len(sizes), dtype=bool), 0
    for _ in range(len(sizes)):
        if held and held + sizes[at] > most:
            number, held = number + 1, 0
        group[at], left[at], held = number, False, held + sizes[at]
        if left.any():
            at = int(np.where(left, centres @ centres[at], -np.inf).argmax())
    return group


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough to be held against all pivots."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def _topk_cells(
    queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType, pivots: int | None, block_rows: int
) -> DataFrame:
    pivots = pivots or min(MAX_PIVOTS, max(16, math.isqrt(corpus.count())))
    # At most ``pivots`` vectors, ids and counts come to the driver below.
    chosen = (
        corpus.where(F.exists("vector", lambda x: x != 0))
        .orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    )
    lowest = [r["id"] for r in corpus.select("id").orderBy("id").limit(k).collect()]
    if not chosen:
        return _ranked(_unscored(queries, lowest, schema), k)
    dims = len(chosen[0]["vector"])
    centres, _ = _unit(_matrix([r["vector"] for r in chosen], dims))

    def distances(block: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (block @ centres.T)))

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            block, known = _unit(_matrix(batch.column("vector"), dims))
            apart = distances(block)
            cell = np.where(known, apart.argmin(axis=1), -1).astype(np.int32)
            radius = np.where(known, apart.min(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array(cell), pa.array(radius)],
                names=["id", "vector", "cell", "radius"],
            )

    placed_schema = T.StructType(
        corpus.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())]
    )
    placed = corpus.mapInArrow(to_cell, placed_schema)
    cells = {
        r["cell"]: (r["n"], r["near"], r["far"])
        for r in placed.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"))
        .collect()
    }
    scored = sorted(c for c in cells if c >= 0)
    cell_ids = np.array(scored, dtype=np.int32)
    sizes = np.array([cells[c][0] for c in scored])
    near = np.array([cells[c][1] for c in scored])
    far = np.array([cells[c][2] for c in scored])
    group = _groups(centres[cell_ids], sizes, min(block_rows, -(-int(sizes.sum()) // LEAST_GROUPS))) if scored else cell_ids
    held = np.bincount(group, weights=sizes).astype(int).tolist() if scored else []

    def to_groups_in_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            block, known = _unit(_matrix(batch.column("vector"), dims))
            apart = distances(block)[:, cell_ids]
            at_most = apart + far
            order = np.argsort(at_most, axis=1)
            enough = np.cumsum(sizes[order], axis=1) >= k
            # The first cell that completes k rows bounds the k-th distance.
            edge = np.where(enough.any(axis=1), enough.argmax(axis=1), len(cell_ids) - 1)
            bound = np.take_along_axis(at_most, np.take_along_axis(order, edge[:, None], 1), 1)
            bound = np.where(enough.any(axis=1)[:, None], bound, np.inf)
            at_least = np.maximum(0.0, np.maximum(apart - far, near - apart))
            # The slack covers scores that only rounding makes equal.
            reach = (at_least**2 <= bound**2 + 1e-8) & known[:, None]
            into = np.zeros((batch.num_rows, len(held)), dtype=bool)
            row, col = np.nonzero(reach)
            into[row, group[col]] = True
            # Some rows at a time: a row leaves once for each group.
            for start in range(0, batch.num_rows, step := max(1, 32 * STEP_ROWS // len(held))):
                row, col = np.nonzero(into[start:start + step])
                own = pa.array(row + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(own), batch.column("vector").take(own), pa.array(col.astype(np.int32))],
                    names=["id", "vector", "group"],
                )

    routed_schema = T.StructType(queries.schema.fields + [T.StructField("group", T.IntegerType())])
    routed = queries.mapInArrow(to_groups_in_reach, routed_schema) if scored else None
    asked = {r["group"]: r["count"] for r in routed.groupBy("group").count().collect()} if scored else {}
    splits = [(g, -(-held[g] // block_rows), -(-n // block_rows)) for g, n in sorted(asked.items())]
    if not splits:
        return _ranked(_unscored(queries, lowest, schema), k)
    # One row a pivot at most.
    of_cells = queries.sparkSession.createDataFrame(
        [(c, g, *n) for c, g in zip(scored, group.tolist()) for h, *n in splits if g == h], "cell int, group int, cparts int, qparts int"
    )
    of_groups = queries.sparkSession.createDataFrame(splits, "group int, cparts int, qparts int")

    def part_of(n):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = placed.join(F.broadcast(of_cells), "cell").select(
        "id", "vector", "group", part_of("cparts").alias("cpart"), every("qparts").alias("qpart")
    )
    right = routed.join(F.broadcast(of_groups), "group").select(
        "id", "vector", "group", every("cparts").alias("cpart"), part_of("qparts").alias("qpart")
    )
    block_key = ["group", "cpart", "qpart"]

    def score_block(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out_q, out_c, out_s = [], [], []
        if len(rows) and len(asks):
            block, known = _unit(_matrix(list(rows["vector"]), dims))
            row_ids = rows["id"].to_numpy()
            ask_ids = asks["id"].to_numpy()
            step = max(1, STEP_SCORES // len(rows))
            for start in range(0, len(asks), step):
                units, _ = _unit(_matrix(list(asks["vector"].iloc[start:start + step]), dims))
                found = _scores(units, block, known)
                for i, line in enumerate(found):
                    best = _best(line, row_ids, k)
                    out_q.extend([ask_ids[start + i]] * len(best))
                    out_c.extend(row_ids[best])
                    out_s.extend(line[best])
        return pd.DataFrame({"query_id": out_q, "match_id": out_c, "similarity": out_s})

    found = left.groupBy(*block_key).cogroup(right.groupBy(*block_key)).applyInPandas(score_block, schema)
    has_length = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    parts = found.unionAll(_unscored(queries.where(~has_length), lowest, schema))
    if sizes.sum() < k:
        # Rows without a score fill up what fewer than k scored rows leave open.
        silent = [r["id"] for r in corpus.where(~has_length).select("id").orderBy("id").limit(k).collect()]
        parts = parts.unionAll(_unscored(queries.where(has_length), silent, schema))
    return _ranked(parts, k)


def _unscored(queries: DataFrame, ids: list, schema: T.StructType) -> DataFrame:
    """The given ids, at most k, as matches without a score for every query."""
    given = F.array(*[F.lit(i) for i in ids]).cast(T.ArrayType(schema["match_id"].dataType))
    return queries.select(
        F.col("id").alias("query_id"), F.explode(given).alias("match_id"),
        F.lit(None).cast("double").alias("similarity"),
    )


def vector_codes(df: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """(id, code): every vector as one signed byte per number, scaled to its own largest.

    A quarter of the bytes of the vectors.  Write the result to a table once
    and search it many times.  A vector without length gets no code.
    """
    source = df.select(F.col(vector_id).alias("id"), F.col(vector).alias("vector"))
    schema = T.StructType([source.schema["id"], T.StructField("code", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            first = next((v for v in vectors if v.is_valid), None)
            rows = _matrix(vectors, len(first) if first is not None else 0)
            top = np.abs(rows).max(axis=1, initial=0.0)
            codes = np.rint(rows / np.where(top > 0, top, 1.0)[:, None] * 127).astype(np.int8)
            coded = [c.tobytes() if t > 0 else None for c, t in zip(codes, top)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(coded, pa.binary())], names=["id", "code"])

    return source.mapInArrow(encode, schema)


def approximate_topk(
    queries: DataFrame, index: DataFrame, corpus: DataFrame, *, query_id: str, query_vector: str, corpus_id: str,
    corpus_vector: str, k: int = 3, candidates: int = 30, max_inline: int = MAX_INLINE_QUERIES,
) -> DataFrame:
    """Candidates by the cosine of their codes, then an exact ranking of those.

    ``index`` comes from :func:`vector_codes` over ``corpus`` and is read whole; more than
    ``max_inline`` queries are refused, as ``operators.vector_index`` serves any number of them.
    """
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("vector")).limit(max_inline + 1).collect()
    if len(asked) > max_inline:
        raise ValueError(f"more than {max_inline} queries: search a stored index (operators.vector_index) instead")
    spark = corpus.sparkSession
    ids = [r["id"] for r in asked]
    dims = next((len(r["vector"]) for r in asked if r["vector"] is not None), 0)
    units, _ = _unit(_matrix([r["vector"] for r in asked], dims))
    id_type = index.schema["id"].dataType
    query_type = queries.schema[query_id].dataType
    near_schema = (
        T.StructType().add("query_id", query_type).add("match_id", id_type).add("similarity", T.DoubleType())
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[tuple[list, list]] = [([], []) for _ in ids]
        for batch in batches:
            codes = b"".join(batch.column("code").to_pylist())
            block, known = _unit(np.frombuffer(codes, np.int8).reshape(batch.num_rows, dims).astype(np.float32))
            found = _scores(units.astype(np.float32), block, known)
            block_ids = np.array(batch.column("id").to_pylist())
            for i, (top_ids, top_scores) in enumerate(top):
                best = _best(found[i], block_ids, candidates)
                merged_ids = np.array(top_ids + block_ids[best].tolist())
                merged = np.array(top_scores + found[i][best].tolist())
                keep = _best(merged, merged_ids, candidates)
                top[i] = (merged_ids[keep].tolist(), merged[keep].tolist())
        out_q = [q for q, (found_ids, _) in zip(ids, top) for _ in found_ids]
        if out_q:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q), pa.array([c for f, _ in top for c in f]),
                 pa.array([float(s) for _, f in top for s in f], pa.float64())],
                names=["query_id", "match_id", "similarity"],
            ).cast(_arrow_schema(near_schema))

    near = _ranked(index.where(F.col("code").isNotNull()).mapInArrow(scan, near_schema), candidates).select("query_id", "match_id")
    # queries x candidates rows at most, by the two limits above.
    wanted = F.broadcast(near)
    vectors = corpus.select(F.col(corpus_id).alias("match_id"), F.col(corpus_vector).alias("vector"))
    asked_vectors = spark.createDataFrame(
        [(r["id"], r["vector"]) for r in asked],
        T.StructType().add("query_id", query_type).add("query_vector", queries.schema[query_vector].dataType),
    )
    pairs = vectors.join(wanted, "match_id").join(F.broadcast(asked_vectors), "query_id")
    return _ranked(
        pairs.select("query_id", "match_id", cosine("query_vector", "vector").alias("similarity")), k
    )


def cosine(a: str, b: str):
    """Cosine of two array columns in double precision; null when one has no length."""
    def total(items):
        return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)

    left, right = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    dot = total(F.zip_with(left, right, lambda x, y: x * y))
    lengths = F.sqrt(total(F.transform(left, lambda x: x * x))) * F.sqrt(total(F.transform(right, lambda x: x * x)))
    return F.round(F.try_divide(dot, lengths), _RANK_DIGITS)
