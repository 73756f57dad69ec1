"""Fuzzy search for short licence notices.

A notice is its words, lower-cased and joined by single spaces; a text is treated the
same way.  Within k edits of a notice that is cut into k + 1 pieces, one piece at least
stands unchanged (pigeonhole), so exact pieces locate candidates.  Around a candidate the
bounded-error matching of the regex library verifies the edits and reports the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, utf8

#: Lower-cases A-Z and turns every ASCII byte that is in no word into a blank.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices that are searched with errors, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
}


@dataclass(frozen=True)
class Notice:
    """A notice with its bound of edits and the pieces of which one survives them."""

    text: str
    label: str
    edits: int
    pieces: tuple[tuple[bytes, int], ...] = field(init=False)
    pattern: object = field(init=False)

    def __post_init__(self):
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        raw = self.text.encode()
        object.__setattr__(self, "pieces", tuple((raw[a:b], a) for a, b in zip(cuts, cuts[1:])))
        object.__setattr__(self, "pattern", regex.compile(rf"(?b)(?<= )(?:{regex.escape(self.text)}){{e<={self.edits}}}(?= )".encode()))


def notices(share: float = 0.1, labels: Mapping[str, str] = NOTICES) -> list[Notice]:
    """The notices (and their labels) with a bound of one edit for every ``1 / share`` letters."""
    return [Notice(t, label, max(1, int(len(t) * share))) for t, label in labels.items()]


def places(text: bytes, phrase: bytes) -> list[int]:
    """Where ``phrase`` stands in a text of words between single blanks, overlaps included."""
    padded, at, found = b" " + phrase + b" ", -1, []
    while (at := text.find(padded, at + 1)) >= 0:
        found.append(at)
    return found


def fuzzy(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in a text of words between single blanks, blanks at both ends.

    Every candidate is verified in a window of its own, which is too short for two notices, so the work grows with the
    candidates.  Of matches that overlap the one of fewer edits stays, then the first.
    """
    length, reach, places = len(notice.text), notice.edits, set()
    for piece, inside in notice.pieces:
        at = text.find(piece)
        while at >= 0:
            places.add(at - inside)
            at = text.find(piece, at + 1)
    whole, matches = notice.text.encode(), set()
    for at in places:
        if at > 0 and text.startswith(whole, at) and text[at - 1:at] == text[at + length:at + length + 1] == b" ":
            matches.add((0, at, at + length))
        elif m := notice.pattern.search(text, max(0, at - reach - 1), at + length + reach + 2):
            matches.add((sum(m.fuzzy_counts), *m.span()))
    found: list[tuple[int, int, int]] = []
    for edits, a, b in sorted(matches):
        i = bisect_left(found, (a, b))
        if (i == 0 or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
            found.insert(i, (a, b, edits))
    return found


def scan_text(text: bytes, wanted: list[Notice]) -> dict:
    """Words, exact places and fuzzy spans (label, first word, last word, edits) of one text."""
    found = text.translate(_WORDS).split()
    flat = b" " + b" ".join(found) + b" "
    starts, base = [], set()
    for phrase, label in BASE.items():
        at = places(flat, phrase.encode())
        starts += at
        if at:
            base.add(label)
    spans, score = [], 1.0 if base else 0.0
    for notice in wanted:
        first, before = -1, 0
        for a, b, edits in fuzzy(flat, notice):
            first, before = first + flat.count(b" ", before, a), a
            spans.append({"label": notice.label, "first": first, "last": first + flat.count(b" ", a, b), "edits": edits})
            score = max(score, 1 - edits / len(notice.text))
    spans.sort(key=lambda s: (s["first"], s["last"], s["label"]))
    word = sorted(flat.count(b" ", 0, at) for at in (min(starts), max(starts))) if starts else [None, None]
    return {
        "n_words": len(found), "n_base": len(starts), "first_word": word[0], "last_word": word[1],
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s["label"] for s in spans})),
        "score": score, "spans": spans,
    }


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())]))
_FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS,
}


def scan(docs: DataFrame, share: float = 0.1, labels: Mapping[str, str] = NOTICES) -> DataFrame:
    """Licence words of every row of ``docs`` (doc_id, text), with the spans of fuzzy matches in words.

    ``labels`` are the notices to search (words between single blanks, lower case) with their labels.
    ``score`` is 1 for an exact base phrase, else the share of letters the best fuzzy match
    kept, else 0.  A null or empty text has no words, no labels and score 0.  Rows are read
    one by one, so repeated ids, null ids and other columns do not matter; an empty table
    gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = notices(share, labels)
        for part in slices(batches):
            rows = [scan_text(t, wanted) for t in utf8(part.column(1))]
            columns = [pa.array([r[n] for r in rows], t) for n, t in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *_FIELDS])

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:long,last:long,edits:int>>"
    )
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
