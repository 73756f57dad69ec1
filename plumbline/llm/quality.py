"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, and runs of signs.  Unigrams and bigrams are hashed
into a fixed number of weights; a text is a sparse vector of length one, and its score the
logistic of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
#: Words whose n-grams are hashed at a time.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Training:
    """``max_rows`` bounds the labelled sample; the rest are the usual settings of the optimiser."""

    max_rows: int = 8192
    epochs: int = 3
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def features(text: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the n-grams; damped counts, scaled to length one.  Index 0 is the bias."""
    counts = np.zeros(0, dtype=np.int64)
    indices = np.zeros(0, dtype=np.int64)
    mask, before = (1 << bits) - 1, np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter((zlib.crc32(m) for m in _WORD.findall(text)), dtype=np.uint64)
    for start in range(0, len(hashes), BLOCK):
        h = np.concatenate([before, hashes[start:start + BLOCK]])
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA77) >> np.uint64(13)
        grams = np.concatenate([h[len(before):], pairs]).astype(np.int64) & mask
        fresh, n = np.unique(grams, return_counts=True)
        indices, back = np.unique(np.concatenate([indices, fresh]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(indices))
        before = h[-1:]
    values = np.log1p(counts)
    length = np.sqrt(values @ values)
    return np.r_[0, indices[indices > 0]], np.r_[1.0, values[indices > 0] / length if length else values]


class Leader:
    """FTRL-Proximal on sparse rows: a learning rate for each weight, weights below ``l1`` exactly zero."""

    def __init__(self, settings: Training):
        self.s = settings
        self.z = np.zeros(1 << settings.bits)
        self.n = np.zeros(1 << settings.bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, s = self.z[at], self.s
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == 0, 0.0, s.l1), 0.0)
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Training = Training()) -> np.ndarray:
    """Weights learned from at most ``max_rows`` labelled texts, those of the smallest hashed ids.

    The sample is read by its ids (a bounded list), turned into features where the texts
    lie, and learned from in one task, one row of an id (of rows that repeat it the one whose
    features sort first); only the fixed number of weights comes back.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    sample = sample.orderBy("place").limit(settings.max_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [features(t, settings.bits) for t in utf8(part.column(2))]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([i for i, _ in rows], pa.list_(pa.int64())),
                pa.array([x for _, x in rows], pa.list_(pa.float64())),
            ], names=["place", "label", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in slices(batches):
            labels = part.column(1).to_pylist()
            rows += [(a.values.to_numpy(), x.values.to_numpy(), y) for a, x, y in zip(part.column(2), part.column(3), labels)]
        leader = Leader(settings)
        for _ in range(settings.epochs):
            for a, x, y in rows:
                leader.learn(a, x, y)
        w = leader.weights(np.arange(1 << settings.bits))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["at", "weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.join(F.broadcast(sample), "doc_id").select("place", "label", "text")
    vectors = chosen.mapInArrow(hashed, "place long, label int, at array<long>, x array<double>")
    one = vectors.groupBy("place", "label").agg(F.min(F.struct("at", "x")).alias("row")).select("place", "label", "row.at", "row.x")
    learned = one.repartition(1).sortWithinPartitions("place").mapInArrow(learn, "at long, weight double").toArrow()
    weights = np.zeros(1 << settings.bits)
    weights[learned["at"].to_numpy()] = learned["weight"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``predicted`` in place of columns of these names.

    Only ``text`` is read.  A null or empty text gets the score of the bias.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # of fixed size
    bits = int(len(weights)).bit_length() - 1
    docs = docs.drop("score", "predicted")
    place = docs.columns.index("text")
    names = [*docs.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in slices(batches):
            sums = np.array([w[at] @ x for at, x in (features(t, bits) for t in utf8(part.column(place)))])
            found = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], names=names
            )

    from pyspark.sql.types import DoubleType, IntegerType, StructType
    schema = StructType([*docs.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, settings: Training = Training(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality (0 or 1; other values and null ids are ignored, of
    repeated ids the larger label and one text count).  Without any label every score is one half.
    Null and empty texts get the score of the bias, null ids are scored and not held out,
    repeated rows get equal scores; other columns are ignored.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, settings), threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
