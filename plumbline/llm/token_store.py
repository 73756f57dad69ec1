"""Token ids in shards of wavelet matrices.

A shard holds the ids of consecutive documents as bit planes, from the highest bit down: a
plane keeps the order of the ids' bits as the planes above have sorted them.  With counts of
ones at every block, access, rank (occurrences before a place) and select (the place of an
occurrence) take one step per plane, on the shard alone.  Shards are rows of a Parquet file,
one file per range of document ids, planes compressed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import shared_folder

from .common import slices, texts
from .tokens import Encoder

#: Bits counted together by the rank directory.
BLOCK = 1024
#: Ids a shard takes before the next document starts another.
SHARD = 1 << 20
END_OF_TEXT = 2


class WaveletMatrix:
    """Ids below 2 ** len(planes), by rank and select on bit planes."""

    def __init__(self, length: int, planes: list[np.ndarray], blocks: list[np.ndarray]):
        self.length, self.planes, self.blocks = length, planes, blocks
        self.zeros = [length - int(b[-1]) for b in blocks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, blocks = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (v & v.dtype.type(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            sums = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if len(packed) else []
            blocks.append(np.r_[0, np.cumsum(sums)].astype(np.uint32))
            v = np.concatenate([v.take(np.flatnonzero(~ones)), v.take(np.flatnonzero(ones))])
        return cls(len(ids), planes, blocks)

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place, from the count at its block and the bytes since."""
        out, packed = self.blocks[plane][at // BLOCK].astype(np.int64), self.planes[plane]
        start, end = at // BLOCK * (BLOCK // 8), at // 8
        for i in np.ndindex(at.shape):
            out[i] += int(np.bitwise_count(packed[start[i]:end[i]]).sum())
            if at[i] % 8:
                out[i] += int(packed[end[i]] & ((1 << int(at[i] % 8)) - 1)).bit_count()
        return out

    def _down(self, plane: int, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        ones = self._ones(plane, at)
        return np.where(one, self.zeros[plane] + ones, at - ones)

    def access(self, at) -> np.ndarray:
        """The ids at some places."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(at.shape, dtype=np.int64)
        for p, packed in enumerate(self.planes):
            one = (packed[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)
            out = out << 1 | one
            at = self._down(p, at, one)
        return out

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the symbol's run starts below the last plane, and where its part before ``end`` ends."""
        low, high = np.int64(0), np.int64(end)
        for p in range(len(self.planes)):
            one = np.bool_(symbol >> (len(self.planes) - 1 - p) & 1)
            low, high = self._down(p, np.array([low, high]), np.array([one, one]))
        return int(low), int(high)

    def rank(self, symbol: int, end: int) -> int:
        """How often ``symbol`` stands before place ``end``."""
        low, high = self._range(symbol, end)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.length)

    def select(self, symbol: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``symbol``."""
        low, high = self._range(symbol, self.length)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for p in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - p) & 1
            at = self._place(p, at - self.zeros[p] if one else at, one)
        return at

    def _place(self, plane: int, k: int, one: int) -> int:
        """The place of bit ``k`` of one kind: its block by the directory, then inside the block."""
        before = self.blocks[plane].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.length) - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        bits = bits[: self.length - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids: from the lowest plane up, each plane tells where its bits stood above it."""
        v = np.zeros(self.length, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, (packed, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            ones = np.unpackbits(packed, count=self.length, bitorder="little").astype(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~ones)] = v[:zeros]
            up[np.flatnonzero(ones)] = v[zeros:] | v.dtype.type(1 << bit)
            v = up
        return v

    def packed(self) -> tuple[list[bytes], list[bytes]]:
        press = zstandard.ZstdCompressor(level=1)
        return [press.compress(p.tobytes()) for p in self.planes], [press.compress(b.tobytes()) for b in self.blocks]

    @classmethod
    def unpacked(cls, length: int, planes: list[bytes], blocks: list[bytes]) -> WaveletMatrix:
        press = zstandard.ZstdDecompressor()
        return cls(
            length, [np.frombuffer(press.decompress(p), dtype=np.uint8) for p in planes],
            [np.frombuffer(press.decompress(b), dtype=np.uint32) for b in blocks],
        )


_SHARDS = (
    "part int, shard int, doc_ids array<long>, lengths array<long>, n_tokens long, planes array<binary>, blocks array<binary>"
)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_OF_TEXT, partitions: int | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) as shards in ascending order of (part, shard) and doc_id.

    Documents are dealt by ranges of their ids; a document is never cut, so one longer than
    a shard has a shard to itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, number = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        bits, end = (encoder.size - 1).bit_length(), np.array([end_id], dtype="<u4").tobytes()
        ids, own, total = [], [], 0

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), dtype="<u4"), bits)
            planes, blocks = matrix.packed()
            row = {
                "part": part, "shard": number, "doc_ids": own, "lengths": [len(i) // 4 for i in ids],
                "n_tokens": total, "planes": planes, "blocks": blocks,
            }
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                ("n_tokens", pa.int64()), ("planes", pa.list_(pa.binary())), ("blocks", pa.list_(pa.binary())),
            ]))

        for batch in slices(batches):
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch.column(1)))):
                own.append(doc)
                ids.append(raw + end)
                total += len(raw) // 4 + 1
                if total >= SHARD:
                    yield shard()
                    ids, own, total, number = [], [], 0, number + 1
        if own:
            yield shard()

    count = [partitions] if partitions else []
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*count, "doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(run, _SHARDS).write.parquet(path)


def read_index(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, shard) of every document, from the ids in the files alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            raw = WaveletMatrix.unpacked(row["n_tokens"], row["planes"], row["blocks"]).decode().astype("<u4").tobytes()
            starts = [0, *accumulate(row["lengths"])]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()), pa.array([row["shard"]] * len(row["doc_ids"]), pa.int32()),
                pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(row["lengths"], pa.int64()),
                pa.array([zlib.crc32(memoryview(raw)[4 * a:4 * b]) for a, b in zip(starts, starts[1:])], pa.int64()),
            ], names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(_SHARDS).parquet(path)
    decoded = shards.mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Places of parts among all, a row each; places of shards within their part.
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("shard_start")).join(parts, "part")
    return decoded.join(places, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )


def occurrences(spark, path: str, token: int) -> DataFrame:
    """(part, shard, n, first): how often a token stands in each shard and where first, by rank and select."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            matrix = WaveletMatrix.unpacked(row["n_tokens"], row["planes"], row["blocks"])
            n = matrix.count(token) if token < 1 << len(matrix.planes) else 0
            yield pa.RecordBatch.from_pylist(
                [{"part": row["part"], "shard": row["shard"], "n": n, "first": matrix.select(token, 0) if n else None}],
                schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("first", pa.int64())]),
            )

    return spark.read.schema(_SHARDS).parquet(path).mapInArrow(run, "part int, shard int, n long, first long")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a folder of shards and return what ``read_index`` finds in it.

    A null text is an empty one and has the end id alone.  Null ids come first, repeated ids
    stand beside each other; other columns are ignored; an empty table gives an empty result.
    """
    path = shared_folder(docs.sparkSession, "llm-shards")
    write_shards(docs, path, tokenizer)
    return read_index(docs.sparkSession, path)
