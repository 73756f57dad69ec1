"""Exact dedup through counting quotient filters.

A normalised text has a fingerprint of 64 bits, cut into a quotient (its high bits) and a
remainder.  Every partition builds a filter: for each quotient in use a run of sorted
remainders, each with its count.  Filters are emitted in slices of quotients and merged by
their sorted remainders without loss.  Only texts whose fingerprint counts above one are
compared byte for byte; the others are alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, slices, stored, texts

#: Quotient bits of a filter slice; the remainder has the other 48.
QUOTIENT_BITS = 16
REMAINDER_BITS = 64 - QUOTIENT_BITS
#: Fingerprints a slice of the merged filter is meant to hold.
SLICE = 1 << 19


class QuotientFilter:
    """Runs of sorted remainders with counts, by quotient."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """From unsigned fingerprints in any order, with repeats."""
        if counts is None:
            counts = np.ones(len(fingerprints), dtype=np.int64)
        order = np.argsort(fingerprints, kind="stable")
        sorted_prints, sorted_counts = fingerprints[order], counts[order]
        fresh = np.flatnonzero(np.r_[True, sorted_prints[1:] != sorted_prints[:-1]][: len(sorted_prints)])
        distinct = sorted_prints[fresh]
        totals = np.add.reduceat(sorted_counts, fresh) if len(fresh) else sorted_counts[:0]
        quotients, runs = np.unique(distinct >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(quotients.astype(np.uint32), runs.astype(np.uint32), distinct & np.uint64((1 << REMAINDER_BITS) - 1), totals)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The filter of all their fingerprints: remainders of a quotient fall into place, counts add up."""
        return cls.build(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]))

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(REMAINDER_BITS) | self.remainders

    def slices(self, shift: int) -> Iterator[tuple[int, QuotientFilter]]:
        """(number, filter) by the quotients' high bits."""
        ends = np.cumsum(self.runs, dtype=np.int64)
        numbers = self.quotients >> np.uint32(shift)
        for n in np.unique(numbers):
            a, b = np.searchsorted(numbers, [n, n + 1])
            lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
            yield int(n), QuotientFilter(self.quotients[a:b], self.runs[a:b], self.remainders[lo:hi], self.counts[lo:hi])

    def packed(self) -> dict[str, bytes]:
        """Quotients and runs as they are, 48 bits for a remainder, counts apart."""
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        return {
            "quotients": self.quotients.astype("<u4").tobytes(), "runs": self.runs.astype("<u4").tobytes(),
            "remainders": np.ascontiguousarray(low).tobytes(), "counts": self.counts.astype("<i8").tobytes(),
        }

    @classmethod
    def unpacked(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        wide = np.zeros((len(counts) // 8, 8), dtype=np.uint8)
        wide[:, : REMAINDER_BITS // 8] = np.frombuffer(remainders, dtype=np.uint8).reshape(-1, REMAINDER_BITS // 8)
        return cls(
            np.frombuffer(quotients, dtype="<u4"), np.frombuffer(runs, dtype="<u4"),
            wide.view("<u8").reshape(-1), np.frombuffer(counts, dtype="<i8"),
        )


def normalised(text: str) -> bytes:
    return text.encode().translate(None, BLANKS)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_points, text_sha256) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = texts(part.column(1))
            flat = [normalised(t) for t in raw]
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array(np.array([xxhash.xxh3_64_intdigest(f) for f in flat], dtype=np.uint64).view(np.int64)),
                pa.array([len(t) for t in raw], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in flat], pa.string()),
            ], names=["doc_id", "fingerprint", "n_points", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, fingerprint long, n_points long, text_sha256 string"
    )


_PACKED = "slice int, quotients binary, runs binary, remainders binary, counts binary"


def partition_filters(prints: DataFrame, shift: int) -> DataFrame:
    """One filter per partition, as rows of slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = None
        for batch in batches:
            new = QuotientFilter.build(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            built = QuotientFilter.merged([built, new]) if built else new
        if built:
            for number, part in built.slices(shift):
                packed = part.packed()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), *[pa.array([v], pa.binary()) for v in packed.values()]], names=["slice", *packed]
                )

    return prints.select("fingerprint").mapInArrow(run, _PACKED)


def repeated_fingerprints(prints: DataFrame, shift: int) -> DataFrame:
    """(fingerprint, count) of those that count above one in the merged filter.

    A merge gets one slice of each partition's filter: a fingerprint that fills the table
    is one remainder with a count in each of them.
    """
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        whole = QuotientFilter.merged([
            QuotientFilter.unpacked(*p) for p in zip(rows["quotients"], rows["runs"], rows["remainders"], rows["counts"])
        ])
        more = whole.counts > 1
        return pa.table({"fingerprint": pa.array(whole.fingerprints()[more].view(np.int64)), "count": pa.array(whole.counts[more], pa.int64())})

    return partition_filters(prints, shift).groupBy("slice").applyInArrow(merge, "fingerprint long, count long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text).

    Texts are equal when identical without the six blanks; null counts as empty.  The longest
    original stays, then the smallest doc_id.  Rows that repeat a doc_id and a text are copies
    of each other: all count, and each carries the same keep_id and is marked kept.  A null
    doc_id comes after all others; a group of nothing else has a null keep_id and keeps its
    rows.  Other columns are ignored; an empty table gives an empty result.
    """
    prints = stored(fingerprinted(docs), "prints")
    slices_wanted = max(1, prints.count() // SLICE)
    shift = max(0, QUOTIENT_BITS - (slices_wanted - 1).bit_length())
    repeated = stored(repeated_fingerprints(prints, shift), "repeated")
    suspects = prints.join(repeated, "fingerprint", "left_semi").select("doc_id").distinct()
    blanks = BLANKS.decode()
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = read.join(suspects.hint("shuffle_hash"), read["doc_id"].eqNullSafe(suspects["doc_id"]), "left_semi")
    # Byte verification: the normalised text is the key, so a group has one text whatever its hashes say.
    grouped = (
        chosen.select(F.translate("text", blanks, "").alias("flat"), F.length("text").cast("long").alias("n_points"), "doc_id")
        .groupBy("flat", "n_points").agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc_id"))
        .groupBy("flat").agg(F.sum("rows").alias("group_size"), F.max_by("doc_id", "n_points").alias("keep_id"))
        .select(F.sha2("flat", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    return prints.join(grouped, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
