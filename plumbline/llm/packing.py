"""Packing of token pieces into sequences by a configuration linear program.

Only the histogram of piece lengths matters to the program, and that is bounded by the
length of a sequence.  A configuration says how many pieces of each length share a sequence.
Multiplicative weights price the lengths, a knapsack by dynamic programming finds the best
configuration at these prices, and the amounts found are rounded; what rounding leaves goes
to the place it fits best.  Pieces then take their places by their rank among equals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_within, slices, stored, texts
from .tokens import Encoder

LIMIT = 1024
END_OF_TEXT = 2


@dataclass(frozen=True)
class Program:
    """How far prices move: they start as the ``power`` of a length's share of a sequence and fall at ``rate`` as demand is met.

    A price round covers at most ``step`` of what a length still lacks by the configuration made for it, and leaves more
    than ``waste`` of a sequence empty in none; ``waste`` grows by ``growth`` once no configuration is that full.
    Rounds end when less than ``gap`` of all tokens is lacking, which best fit places.
    """

    step: float = 1.0
    rate: float = 0.5
    power: float = 2.0
    waste: float = 1 / 4096
    growth: float = 4.0
    gap: float = 0.001


def best_configuration(lengths: np.ndarray, values: np.ndarray, supply: np.ndarray, limit: int) -> dict[int, int]:
    """The most valuable {length: pieces} within ``limit``: a bounded knapsack, pieces taken in powers of two."""
    items = []
    for l, v, n in zip(lengths.tolist(), values.tolist(), supply.tolist()):
        n, some = min(n, limit // l), 1
        while n > 0:
            items.append((l, min(some, n), v * min(some, n)))
            n, some = n - some, some * 2
    best = np.zeros(limit + 1)
    taken = np.zeros((len(items), limit + 1), dtype=bool)
    for i, (l, some, value) in enumerate(items):
        w = l * some
        with_it = best[:-w] + value
        np.greater(with_it, best[w:] + 1e-12, out=taken[i, w:])
        np.maximum(best[w:], with_it, out=best[w:])
    found: Counter[int] = Counter()
    room = limit
    for i in range(len(items) - 1, -1, -1):
        if taken[i, room]:
            found[items[i][0]] += items[i][1]
            room -= items[i][0] * items[i][1]
    return dict(found)


def best_values(lengths: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the value of its most valuable filling, and the place of one length in it (-1: a unit stays empty)."""
    best, last = np.zeros(limit + 1), np.full(limit + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(limit + 1), side="right")
    for room in range(1, limit + 1):
        best[room] = best[room - 1]
        if k := fitting[room]:
            value = best[room - lengths[:k]] + values[:k]
            at = int(value.argmax())
            if value[at] > best[room] + 1e-12:
                best[room], last[room] = value[at], at
    return best, last


def configuration(first: int, lengths: np.ndarray, last: np.ndarray, limit: int) -> tuple[dict[int, int], int]:
    """The best filling that holds the length at place ``first``, by places, and the room it leaves."""
    found, room, empty = {first: 1}, limit - int(lengths[first]), 0
    while room > 0:
        at = int(last[room])
        if at < 0:
            room, empty = room - 1, empty + 1
        else:
            found[at] = found.get(at, 0) + 1
            room -= int(lengths[at])
    return found, empty


def fractional(histogram: dict[int, int], limit: int, program: Program) -> list[tuple[dict[int, int], float]]:
    """Configurations with their amounts in the program's solution, by multiplicative weights.

    One knapsack table prices the best configuration of every length; where all of them want more pieces than there are,
    a knapsack within the supply prices the next one.  Rounds go on until the gap is reached or less than one piece of any length lacks.
    """
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[l] for l in lengths.tolist()], dtype=float)
    lacking, amounts, waste = demand.copy(), {}, program.waste * limit
    while True:
        open_ = np.flatnonzero(lacking >= 1)
        if not len(open_) or lengths @ lacking < program.gap * (lengths @ demand):
            break
        own = lengths[open_]
        price = (own / limit) ** program.power * np.exp(-program.rate * (1 - lacking[open_] / demand[open_]))
        _, last = best_values(own, price, limit)
        placed = False

        def place(chosen: dict[int, int], amount: float) -> None:
            for at, each in chosen.items():
                lacking[open_[at]] -= each * amount
            key = tuple(sorted((int(own[at]), each) for at, each in chosen.items()))
            amounts[key] = amounts.get(key, 0.0) + amount

        for first in range(len(open_) - 1, -1, -1):
            chosen, empty = configuration(first, own, last, limit)
            most = min(lacking[open_[at]] / each for at, each in chosen.items())
            if empty > waste or most < 1:
                continue
            place(chosen, min(most, max(1.0, program.step * lacking[open_[first]])))
            placed = True
        if not placed and waste < limit:
            waste = max(waste, 1.0) * program.growth
        elif not placed:
            scarce = best_configuration(own, price, np.floor(lacking[open_]).astype(int), limit)
            chosen = {int(np.searchsorted(own, l)): n for l, n in scarce.items()}
            place(chosen, min(lacking[open_[at]] // each for at, each in chosen.items()))
    return [(dict(k), x) for k, x in amounts.items()]


def best_fit(bins: list[tuple[dict[int, int], int]], left: dict[int, int], limit: int) -> list[tuple[dict[int, int], int]]:
    """Put every remaining piece, longest first, into the fullest sequences that still take it, else into new ones.

    Sequences of equal content are one entry with their number.
    """
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for content, n in bins:
        by_room.setdefault(limit - sum(l * k for l, k in content.items()), []).append((content, n))
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r, own in by_room.items() if r >= length and own), default=None)
            if room is None:
                content, many = {}, n
                room = limit
            else:
                content, many = by_room[room].pop()
            each = min(room // length, n)
            used = min(many, n // each)
            if used < many and room != limit:
                by_room[room].append((content, many - used))
            filled = dict(content)
            filled[length] = filled.get(length, 0) + each
            by_room.setdefault(room - each * length, []).append((filled, used))
            n -= each * used
    return [b for own in by_room.values() for b in own]


def solve(histogram: dict[int, int], limit: int = LIMIT, program: Program = Program()) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences take each; together exactly the histogram."""
    left = {l: n for l, n in histogram.items() if n and l < limit}
    chosen: Counter[tuple] = Counter()
    if left:
        for content, amount in sorted(fractional(left, limit, program), key=lambda c: -c[1]):
            many = min(int(amount + 0.5), *(left[l] // k for l, k in content.items()))
            if many > 0:
                chosen[tuple(sorted(content.items()))] += many
                for l, k in content.items():
                    left[l] -= k * many
        left = {l: n for l, n in left.items() if n}
    bins = best_fit([(dict(c), n) for c, n in chosen.items()], left, limit)
    if histogram.get(limit):
        bins.append(({limit: 1}, histogram[limit]))
    return bins


class Places:
    """Where the piece of a length and a rank goes."""

    def __init__(self, bins: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        filled: Counter[int] = Counter()
        sequence = 0
        for content, many in bins:
            offset = 0
            for length, each in sorted(content.items(), reverse=True):
                rows.setdefault(length, []).append((filled[length], sequence, each, offset))
                filled[length] += each * many
                offset += each * length
            sequence += many
        self.sequences = sequence
        self.by_length = {l: np.array(r, dtype=np.int64) for l, r in rows.items()}

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.by_length[length]
        own = rows[np.searchsorted(rows[:, 0], ranks, side="right") - 1]
        inside = ranks - own[:, 0]
        return own[:, 1] + inside // own[:, 2], own[:, 3] + inside % own[:, 2] * length


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_OF_TEXT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every row's ids with the end id, cut from the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(texts(batch.column(1)))):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % limit + 1, n + 1, limit)]
                rows += [
                    (doc, i, a, b - a, zlib.crc32(memoryview(raw)[4 * a:4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
                ]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def packed(docs: DataFrame, tokenizer: str, limit: int = LIMIT, program: Program = Program()) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text) with their ``sequence_id`` and ``offset``.

    A null or empty text has the end id alone.  Repeated rows and null ids are packed like any
    other; other columns are ignored; an empty table gives an empty result.  The driver sees
    the counts of at most ``limit`` lengths.
    """
    cut = stored(pieces(docs, tokenizer, limit), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(solve(histogram, limit, program))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths).tolist():
                own = lengths == length
                sequence[own], offset[own] = places.of(length, ranks[own])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    ranked = rank_within(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
