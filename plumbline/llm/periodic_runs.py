"""Runs of repeated words, by a suffix automaton whose links are a link-cut tree.

The automaton grows by a word at a time.  On the path from the newest state to the root stand the suffixes of what has
been read, cut into segments of states with one last occurrence each; a segment is a preferred path
of the link-cut tree.  Appending a word makes the whole path one segment that ends here.  Where an older
segment ended at a distance d before and its longest suffix has d words or more, two equal
neighbours of d words end here: a square, extended to the run it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: Words of a window that must recur, and odd factors of its hash.
WINDOW = 8
FACTORS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Shape:
    """Least words and least repetitions of a run; from 24 and 3 on a run's windows recur in it, see ``recurring``."""

    words: int = 24
    times: int = 3

    def __post_init__(self):
        if self.times < 3 or self.words < 3 * WINDOW:
            raise ValueError(f"runs have 3 repetitions and {3 * WINDOW} words or more")


class Suffixes:
    """An automaton of the suffixes of a growing sequence, and the segments of last occurrences in its links.

    States are numbers from 1, the root; 0 is none.  A state keeps one transition by itself and further ones in a
    dictionary.  Segments are splay trees ordered by depth (``left`` is nearer the root); ``end`` of a tree's
    root is where the segment's strings ended last, ``above`` leads from there to the segment before.
    """

    def __init__(self, words: int):
        room = 2 * words + 2
        self.size, self.last, self.read = 2, 1, 0
        self.length, self.link, self.word, self.next = ([0] * room for _ in range(4))
        self.left, self.right, self.above, self.end = ([0] * room for _ in range(4))
        self.more: dict[int, dict[int, int]] = {}
        self.word[1] = self.end[1] = -1

    def _state(self, length: int) -> int:
        state, self.size = self.size, self.size + 1
        self.length[state], self.word[state], self.end[state] = length, -1, -1
        return state

    def _extend(self, c: int) -> int:
        """The state of the whole sequence with a word ``c`` more."""
        length, link, word, nxt, more = self.length, self.link, self.word, self.next, self.more
        p, new = self.last, self._state(self.read + 1)
        while p:
            if word[p] < 0:
                word[p], nxt[p] = c, new
            elif word[p] == c:
                q = nxt[p]
                break
            elif p not in more:
                more[p] = {c: new}
            elif (q := more[p].get(c)):
                break
            else:
                more[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        elif length[q] == length[p] + 1:
            link[new] = q
        else:
            link[new] = link[q] = self._split(p, q, c)
        self.above[new] = link[new]
        self.last, self.read = new, self.read + 1
        return new

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the strings of ``q`` that also end here; it stands over ``q`` on its segment."""
        link, word, nxt, more = self.link, self.word, self.next, self.more
        twin = self._state(self.length[p] + 1)
        link[twin], word[twin], nxt[twin] = link[q], word[q], nxt[q]
        if q in more:
            more[twin] = dict(more[q])
        while p:
            if word[p] == c:
                if nxt[p] != q:
                    break
                nxt[p] = twin
            elif p in more and more[p].get(c) == q:
                more[p][c] = twin
            else:
                break
            p = link[p]
        self._splay(q)
        inner = self.left[q]
        self.left[twin], self.left[q], self.above[twin] = inner, twin, q
        if inner:
            self.above[inner] = twin
        return twin

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its segment's tree."""
        left, right, above = self.left, self.right, self.above
        top = 0
        while (p := above[x]) and (left[p] == x or right[p] == x):
            g = above[p]
            inside = g and (left[g] == p or right[g] == p)
            if inside and (left[g] == p) == (left[p] == x):
                self._rotate(p)
            elif inside:
                self._rotate(x)
            top = g if inside else p
            self._rotate(x)
        if top:
            self.end[x] = self.end[top]

    def _rotate(self, x: int) -> None:
        left, right, above = self.left, self.right, self.above
        p = above[x]
        g = above[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            above[b] = p
        above[p], above[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def append(self, c: int) -> list[tuple[int, int]]:
        """Read a word: (distance, common length) of earlier ends that a square of that distance comes from."""
        here = self.read
        x = new = self._extend(c)
        above, right, end, length = self.above, self.right, self.end, self.length
        squares, lower, x = [], new, above[new]
        while x:
            self._splay(x)
            distance = here - end[x]
            if length[x] >= distance:
                squares.append((distance, length[x]))
            if right[x]:
                end[right[x]] = end[x]
            right[x] = lower
            lower, x = x, above[x]
        self._splay(new)
        end[new] = here
        return squares


def runs(words: list[int], shape: Shape = Shape()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``shape`` in a sequence, by start, then period."""
    suffixes, n = Suffixes(len(words)), len(words)
    reach: dict[int, int] = {}
    found = []
    for i, c in enumerate(words):
        for period, common in suffixes.append(c):
            if i <= reach.get(period, -1):
                continue
            last = i
            while last + 1 < n and words[last + 1] == words[last + 1 - period]:
                last += 1
            reach[period] = last
            start = i - common - period + 1
            if last - start + 1 >= max(shape.words, shape.times * period):
                found.append((start, last - start + 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def recurring(hashed: np.ndarray, shape: Shape = Shape()) -> list[tuple[int, int]]:
    """(first, past the last) of stretches of words that can hold runs, and no run lies outside one.

    In a run of three periods and 24 words any 8 words in a row stand again a period before or
    after.  So a window of 8 that occurs once in the text is in no run; what is left
    is cut there.  Windows are compared by hashes: a clash only leaves more to look at.
    """
    if len(hashed) < shape.words:
        return []
    h, step = hashed, 1
    for factor in FACTORS:
        h, step = h[:-step] * np.uint64(factor) + h[step:], 2 * step
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(h) + 2, dtype=np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edges = np.flatnonzero(np.diff(again)).reshape(-1, 2)
    long = edges[:, 1] - edges[:, 0] + WINDOW - 1 >= shape.words
    return [(int(a), int(b) + WINDOW - 1) for a, b in edges[long]]


def text_runs(words: list[bytes], shape: Shape = Shape()) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    found = set()
    for a, b in recurring(hashed, shape):
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found.update((start + a, length, period) for start, length, period in runs(own, shape))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run, or among the first of its period in every run they are in."""
    if not found:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def detect(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    Words are what the six ASCII blanks part.  ``runs`` is an array of start, length and period by start, then period;
    ``collapsed`` the words with every run cut to its first period, one blank between.  A null text has no
    words, and a text without runs only its blanks changed; rows that repeat or have no doc_id are
    rows like others.  Nothing is shuffled; a worker holds one text at a time.  Other columns are
    ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for part in slices(batches):
            counts, all_runs, left = [], [], []
            for text in utf8(part.column(1)):
                words = text.split()
                found = text_runs(words, shape)
                counts.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                left.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(left, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    )


def digests(found: DataFrame) -> DataFrame:
    """What the audit reports of the rows of ``detect``: counts, the run repeated most often, and digests."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    most = F.reduce("runs", F.element_at("runs", 1), lambda a, b: F.when(more(a, b), b).otherwise(a))
    best = F.when(F.size("runs") > 0, most)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic end in every tenth text, chosen and shaped by the checksum of its doc_id.

    Words from a on repeat the p words after a.  A null doc_id has no checksum: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, a, p = (F.col(c) for c in ("_n", "_a", "_p"))
    chosen = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_words").cast("long"))
    chosen = chosen.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.call_function("div", n - F.col("_a"), 3 + g % 8) + 1)
    turned = F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.element_at("_words", (a + (i - a) % p + 1).cast("int"))))
    return chosen.withColumn("text", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text"))).drop("_words", "_n", "_a", "_p")
