"""Approximate nearest neighbours by collision counting.

The largest inner product becomes the smallest distance by one more coordinate, which lifts
every vector to the same length.  A hash is a single projection; its index is the sorted array
of projections.  A query opens a window around its own projection in every array, and a vector
collides where it lies in the window.  Virtual rehashing widens all windows step by step;
vectors that collide often enough are verified with their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Search:
    """How the index is built and searched.

    Projections come as ``rotations`` random orthonormal bases.  Windows start at ``width`` standard
    deviations of a projection and grow by ``growth``; a vector needs ``collisions`` (a share of all
    arrays) to be verified; windows stop growing when ``verified`` (a share of the segment) or ``least``
    vectors, whichever is more, have been reached.  ``segment`` vectors share an index, ``block``
    queries go through it together.
    """

    rotations: int = 2
    width: float = 0.6
    growth: float = 1.1
    collisions: float = 0.55
    verified: float = 0.1
    least: int = 600
    segment: int = 8192
    block: int = 4096
    seed: int = 11


def rotations(dims: int, search: Search) -> np.ndarray:
    """(dims, projections): random orthonormal bases side by side, the same on every worker."""
    rng = np.random.default_rng(search.seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(search.rotations)], axis=1)


class Segment:
    """Sorted projections of some vectors, and the vectors themselves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, search: Search):
        self.ids, self.vectors, self.longest, self.search = ids, vectors, longest, search
        lift = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0.0))
        self.bases = rotations(vectors.shape[1] + 1, search)
        found = (np.column_stack([vectors, lift]) @ self.bases).T
        self.order = np.argsort(found, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(found, self.order, axis=1)

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """For every query the places of the vectors to verify."""
        s, n = self.search, len(self.ids)
        lengths = np.sqrt((queries ** 2).sum(axis=1, keepdims=True))
        centres = (np.column_stack([queries * (self.longest / lengths), np.zeros(len(queries))]) @ self.bases).T
        unit = self.longest / np.sqrt(self.bases.shape[0])
        needed = max(1, round(s.collisions * len(self.order)))
        wanted = min(n, max(s.least, round(s.verified * n)))
        counts = [np.zeros(n, dtype=np.int16) for _ in range(len(queries))]
        low = np.stack([np.searchsorted(a, c) for a, c in zip(self.sorted, centres)])
        high = low.copy()
        width, open_ = s.width * unit, np.arange(len(queries))
        done: dict[int, np.ndarray] = {}
        while len(open_):
            now_low = np.stack([np.searchsorted(a, c) for a, c in zip(self.sorted, centres[:, open_] - width)])
            now_high = np.stack([np.searchsorted(a, c, side="right") for a, c in zip(self.sorted, centres[:, open_] + width)])
            for k, q in enumerate(open_.tolist()):
                # Only what the wider windows add is counted.
                rings = [o[a:b] for o, a, b in zip(self.order, now_low[:, k].tolist(), low[:, q].tolist())]
                rings += [o[a:b] for o, a, b in zip(self.order, high[:, q].tolist(), now_high[:, k].tolist())]
                counts[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int16)
                reached = np.flatnonzero(counts[q] >= needed)
                if len(reached) >= wanted:
                    done[q], counts[q] = reached, counts[q][:0]
            low[:, open_], high[:, open_] = now_low, now_high
            open_ = np.array([q for q in open_.tolist() if q not in done], dtype=int)
            width *= s.growth
        for q in range(len(queries)):
            yield done[q]

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, ids, scores, verified) of the best ``k`` verified vectors, but for the query's own."""
        for q, (query, at) in enumerate(zip(query_ids.tolist(), self.candidates(queries))):
            at = at[self.ids[at] != query]
            scores = (self.vectors[at] * queries[q]).sum(axis=1)  # row by row: equal vectors tie
            if len(at) > k:
                edge = np.partition(scores, len(at) - k)[len(at) - k]
                keep = scores >= edge
                at_kept, scores_kept = at[keep], scores[keep]
            else:
                at_kept, scores_kept = at, scores
            best = np.lexsort((self.ids[at_kept], -scores_kept))[:k]
            yield query, self.ids[at_kept][best], scores_kept[best], len(at)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, length) without nulls, non-finite components and zero vectors."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.where("vec_id is not null and embedding is not null").where(~bad).withColumn("length", length).where("length > 0")


_FOUND = "query_id long, vec_id long, score double, verified long"


def search(index: DataFrame, queries: DataFrame, k: int = 20, how: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products found, and how many vectors were verified.

    ``index`` and ``queries`` have vec_id and embedding.  Vectors that are null, zero or hold null
    or non-finite components take no part; a query without such faults finds min(k, others) rows.
    The dimension is the commonest one of the index (of equally common ones the smallest), and vectors of
    others take no part; ties go to the smaller vec_id; a row
    that repeats a vec_id is a candidate of its own.  Other columns are ignored; empty tables give
    an empty result.  Each segment of the index meets the queries in blocks.
    """
    rows, dims = stored(usable(index), "vectors"), F.size("embedding")
    shapes = rows.groupBy(dims.alias("dims")).agg(F.count("*").alias("n"), F.max("length").alias("longest"))
    size, count, longest = shapes.orderBy(F.desc("n"), "dims").first() or (0, 0, None)
    rows = rows.where(dims == size)
    segments = max(1, -(-count // how.segment))
    asked = stored(usable(queries).where(dims == size).select("vec_id", "embedding"), "queries")
    blocks = max(1, -(-asked.count() // how.block))
    longest = float(longest or 1.0)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> np.ndarray:
            column = t.column("embedding").combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

        found = {"query_id": [], "vec_id": [], "score": [], "verified": []}
        if left.num_rows and right.num_rows:
            segment = Segment(left.column("vec_id").to_numpy(), matrix(left), longest, how)
            for query, ids, scores, n in segment.nearest(right.column("vec_id").to_numpy(), matrix(right), k):
                found["query_id"] += [query] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += scores.tolist()
                found["verified"] += [n] * len(ids)
        return pa.table(found, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())]))

    def keyed(df: DataFrame, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id", F.lit(how.seed)), F.lit(own_count)).cast("int")
        return df.select("vec_id", "embedding", number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))).alias(other))

    left = keyed(rows, "segment", segments, "block", blocks).groupBy("segment", "block")
    right = keyed(asked, "block", blocks, "segment", segments).groupBy("segment", "block")
    found = left.cogroup(right).applyInArrow(meet, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = Window.partitionBy("query_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).withColumn("verified", F.sum("verified").over(every) / F.count("*").over(every))
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
    )
