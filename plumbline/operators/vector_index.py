"""A stored index for approximate vector search that skips files.

Vectors go to the cell of their nearest centre, and neighbouring cells share a folder.  The index is a Parquet table in
those folders, with one signed byte per number beside each vector, and a small table of the cells.  A search reads the
folders of the cells its queries probe, ranks the codes of those cells, and scores only the best candidates on their vectors.
One plan serves one query or a million: queries and codes meet in blocks of a folder, and large folders are cut on both sides.

Vectors that are null, without length, not finite or of another size than most take no part, on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import _best, _matrix, _ranked, _scores, _unit, cosine

#: Most cells of an index, rows a cell is meant to hold below that, sampled vectors for each cell, and passes over the sample.
MAX_CELLS = 4096
CELL_ROWS = 4
SAMPLED = 8
ROUNDS = 8
#: Most folders of an index, and cells a folder is meant to hold below that.
MAX_FOLDERS = 64
FOLDER_CELLS = 16
#: Share of the rows that the probed cells of a query hold at most; the first cell is always probed.
REACH = 0.19
BLOCK_ROWS = 20_000
CANDIDATES = 30
#: Vectors a task holds against all centres at a time, and scores it holds at a time.
STEP_ROWS = 512
STEP_SCORES = 2_000_000


def _usable(vector: str, dims: int) -> Column:
    values = F.col(vector)
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(values) == dims) & finite & F.exists(values, lambda x: x != 0), F.lit(False))


def _read(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough to be held against all centres."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def fit_centres(rows: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit rows by k-means on the sphere, started at evenly spaced rows; as many as there are rows at most."""
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(rows[i:i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
        order = np.argsort(nearest, kind="stable")
        own, starts = np.unique(nearest[order], return_index=True)
        sums, known = _unit(np.add.reduceat(rows[order], starts, axis=0))
        centres[own[known]] = sums[known]
    return centres


def _folders(centres: np.ndarray) -> np.ndarray:
    """The folder of every cell: cells whose centres are near each other share one."""
    if not len(centres):
        return np.zeros(0, dtype=np.int32)
    wide = fit_centres(centres, min(MAX_FOLDERS, -(-len(centres) // FOLDER_CELLS)))
    return (centres @ wide.T).argmax(axis=1).astype(np.int32)


def build(corpus: DataFrame, path: str, *, corpus_id: str, corpus_vector: str, cells: int | None = None) -> int:
    """Write the index of ``corpus`` below ``path`` and return the size of its vectors, 0 for an empty index.

    Centres are fitted on at most ``SAMPLED`` vectors for each cell, chosen by a hash of the id; every vector is indexed.  Without
    ``cells`` a cell is meant for ``CELL_ROWS`` rows, and there are at most ``MAX_CELLS``.  Folders that
    hold much of the table are written by several tasks.
    """
    spark, rows = corpus.sparkSession, _read(corpus, corpus_id, corpus_vector)
    most = rows.where("vector is not null").groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, total = (most["dims"], most["count"]) if most else (0, 0)
    usable = rows.where(_usable("vector", dims))
    cells = min(MAX_CELLS, max(1, total // CELL_ROWS)) if cells is None else cells
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLED).select("vector").toArrow().column("vector")
    centres = fit_centres(_unit(_matrix(sample, dims))[0], cells) if len(sample) else np.zeros((0, dims))
    folders = _folders(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            block = _matrix(batch.column("vector"), dims)
            codes = np.rint(block / np.abs(block).max(axis=1)[:, None] * 127).astype(np.int8)
            cell = (_unit(block)[0] @ centres.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(cell), pa.array(folders[cell])],
                names=["id", "vector", "code", "cell", "cell_folder"],
            )

    schema = T.StructType([*usable.schema.fields]).add("code", T.BinaryType()).add("cell", T.IntegerType()).add("cell_folder", T.IntegerType())
    usable.mapInArrow(place, schema).hint("rebalance", "cell_folder").write.partitionBy("cell_folder").parquet(f"{path}/vectors")
    known = [(i, f, c) for i, (f, c) in enumerate(zip(folders.tolist(), centres.tolist()))]
    spark.createDataFrame(known, "cell int, cell_folder int, centre array<double>").join(
        spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("rows")), "cell"
    ).coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(dims, str(usable.schema["id"].dataType.simpleString()))], "dims int, id_type string").write.parquet(f"{path}/about")
    return dims


class Index:
    """A written index.  Its cells are few by construction and known to the driver."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").first()
        cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda c: c["cell"])
        self.dims, self.id_type = about["dims"], about["id_type"]
        self.cells = np.array([c["cell"] for c in cells], dtype=np.int32)
        self.folders = np.array([c["cell_folder"] for c in cells], dtype=np.int32)
        self.centres = np.array([c["centre"] for c in cells]).reshape(len(cells), self.dims)
        self.rows = np.array([c["rows"] for c in cells], dtype=np.int64)
        stored = f"id {self.id_type}, vector array<float>, code binary, cell int, cell_folder int"
        self.vectors = spark.read.schema(stored).parquet(f"{path}/vectors")

    def route(self, queries: DataFrame, probes: int | None, reach: float) -> DataFrame:
        """(id, vector, cell_folder, cells, pairs): a row for every folder in which a query probes cells, with
        those cells and the rows they hold.

        Either the nearest ``probes`` cells, or as many as hold ``reach`` of the rows together.
        """
        dims, cells, folders, centres, rows = self.dims, self.cells, self.folders, self.centres, self.rows
        most = reach * rows.sum()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _steps(batches) if len(cells) else ():
                order = np.argsort(-(_unit(_matrix(batch.column("vector"), dims))[0] @ centres.T), axis=1, kind="stable")
                chosen = np.cumsum(rows[order], axis=1) <= most
                if probes is not None:
                    chosen = np.broadcast_to(np.arange(len(cells)) < probes, order.shape).copy()
                chosen[:, 0] = True
                row, place = np.nonzero(chosen)
                cell = order[row, place]
                by = np.lexsort((cell, folders[cell], row))
                row, cell = row[by], cell[by]
                starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(folders[cell]) != 0)])
                own = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(own), batch.column("vector").take(own), pa.array(folders[cell[starts]]),
                     pa.ListArray.from_arrays(pa.array(np.r_[starts, len(cell)].astype(np.int32)), pa.array(cells[cell])),
                     pa.array(np.add.reduceat(rows[cell], starts))],
                    names=["id", "vector", "cell_folder", "cells", "pairs"],
                )

        schema = T.StructType([*queries.schema.fields]).add("cell_folder", T.IntegerType())
        schema = schema.add("cells", T.ArrayType(T.IntegerType())).add("pairs", T.LongType())
        return queries.where(_usable("vector", dims)).mapInArrow(run, schema)

    def probed(self, routed: DataFrame) -> DataFrame:
        """(cell_folder, pairs, cparts, qparts): how many pairs are ranked in a folder, and the parts each side is cut into."""
        asked = routed.groupBy("cell_folder").agg(F.count("*").alias("asked"), F.sum("pairs").alias("pairs")).collect()
        size = np.bincount(self.folders, weights=self.rows).astype(np.int64).tolist() if len(self.cells) else []
        rows = [(a["cell_folder"], a["pairs"], -(-size[a["cell_folder"]] // BLOCK_ROWS), -(-a["asked"] // BLOCK_ROWS)) for a in asked]
        return routed.sparkSession.createDataFrame(rows, "cell_folder int, pairs long, cparts int, qparts int")


def search(
    queries: DataFrame, path: str, *, query_id: str, query_vector: str, k: int = 3, candidates: int = CANDIDATES,
    probes: int | None = None, reach: float = REACH,
) -> DataFrame:
    """(query_id, match_id, similarity, rank): the best ``k`` found by cosine for each query.

    Candidates are ranked by their codes and scored on their vectors.  Query ids are taken to be distinct.  A query whose vector
    is not usable has no rows, and one whose cells hold fewer than ``k`` rows has fewer.  Only the folders
    of probed cells are read.
    """
    spark = queries.sparkSession
    index, asked = Index(spark, path), _read(queries, query_id, query_vector)
    routed = index.route(asked, probes, reach)
    # One row a folder: both the list of folders and the frame are bounded by MAX_FOLDERS.
    meet = index.probed(routed)
    wanted = [r["cell_folder"] for r in meet.select("cell_folder").collect()]
    stored = index.vectors.where(F.col("cell_folder").isin(wanted))
    parts = F.broadcast(meet.select("cell_folder", "cparts", "qparts"))

    def of(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = stored.join(parts, "cell_folder").select(
        "id", "code", "cell", "cell_folder", of("cparts").alias("cpart"), every("qparts").alias("qpart")
    )
    right = routed.join(parts, "cell_folder").select(
        "id", "vector", "cells", "cell_folder", every("cparts").alias("cpart"), of("qparts").alias("qpart")
    )
    dims = index.dims

    def score(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asks):
            rows = rows.sort_values("cell", kind="stable")
            block, known = _unit(np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), dims).astype(np.float64))
            row_ids, row_cells = rows["id"].to_numpy(), rows["cell"].to_numpy()
            own, starts = np.unique(row_cells, return_index=True)
            ends = np.r_[starts[1:], len(rows)]
            step = max(1, STEP_SCORES // len(rows))
            for start in range(0, len(asks), step):
                some = asks.iloc[start:start + step]
                units, _ = _unit(_matrix(list(some["vector"]), dims))
                probed = np.concatenate(some["cells"].to_list())
                asking = np.repeat(np.arange(len(some)), some["cells"].str.len().to_numpy())
                asking = asking[by := np.argsort(probed, kind="stable")]
                low, high = np.searchsorted(probed[by], own), np.searchsorted(probed[by], own, side="right")
                # Only the cells that a query probes are scored; the rest stays out of reach.
                lines = np.full((len(some), len(rows)), -np.inf)
                for a, b, i, j in zip(low.tolist(), high.tolist(), starts.tolist(), ends.tolist()):
                    if a < b:
                        lines[asking[a:b], i:j] = _scores(units[asking[a:b]], block[i:j], known[i:j])
                for ask, line in zip(some["id"], lines):
                    best = _best(line, row_ids, candidates)
                    best = best[line[best] > -np.inf]
                    found.append((np.full(len(best), ask, dtype=object), row_ids[best], line[best]))
        query, match, similarity = zip(*found) if found else ([[]],) * 3
        return pd.DataFrame({
            "query_id": np.concatenate(query), "match_id": np.concatenate(match), "similarity": np.concatenate(similarity),
            "cell_folder": rows["cell_folder"].iloc[0] if len(rows) else 0,
        })

    schema = (
        T.StructType().add("query_id", asked.schema["id"].dataType).add("match_id", index.vectors.schema["id"].dataType)
        .add("similarity", T.DoubleType()).add("cell_folder", T.IntegerType())
    )
    block = ["cell_folder", "cpart", "qpart"]
    near = _ranked(left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(score, schema), candidates)
    vectors = stored.select("cell_folder", F.col("id").alias("match_id"), "vector")
    pairs = near.select("query_id", "match_id", "cell_folder").join(vectors, ["cell_folder", "match_id"]).join(
        asked.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id"
    )
    return _ranked(pairs.select("query_id", "match_id", cosine("query_vector", "vector").alias("similarity")), k)


def cost(
    queries: DataFrame, path: str, *, query_id: str, query_vector: str, probes: int | None = None, reach: float = REACH
) -> DataFrame:
    """(queries, pairs, share): what a search would rank, and its share of all queries with all rows."""
    index = Index(queries.sparkSession, path)
    asked = _read(queries, query_id, query_vector)
    meet = index.probed(index.route(asked, probes, reach)).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    known = asked.where(_usable("vector", index.dims)).agg(F.count("*").alias("queries"))
    every = F.col("queries") * F.lit(int(index.rows.sum()))
    return known.select("queries", meet.scalar().alias("pairs")).withColumn("share", F.try_divide(F.col("pairs"), every))
