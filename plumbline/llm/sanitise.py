"""Personal data, and the terms that give it away.

Base patterns find addresses and numbers.  A protected entity is one such value.  Over the
whole corpus, co-occurrence tells how much of an entity's information a term carries:
PMI(term; entity) as a share of the entity's own information content.  In texts that hold
the entity, terms above one share are generalised, above a higher one removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, texts
from .spans import Span, joined

KINDS = ["email", "ip", "card", "phone"]
ACTIONS = ["generalise", "remove"]

#: The base patterns.  A match of digits starts where its run starts, so the
#: look-behind and the possessive runs change no result; they keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TERM = re.compile(r"[^\W\d_]{4,}")
#: Terms a task counts before it hands its counts on.
FLUSH = 200_000


@dataclass(frozen=True)
class Disclosure:
    """Shares of an entity's information that a term may carry, and the distinct texts that must bear it out."""

    generalise: float = 0.7
    remove: float = 0.9
    support: int = 3


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


def entity(kind: str, value: str) -> str:
    """A protected value whatever its spelling."""
    return f"{kind}:" + (value.lower() if kind in ("email", "ip") else _digits(value))


def term_spans(text: str, base: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside the base spans."""
    taken = sorted((a, b) for _, a, b in base)
    i, end = 0, 0
    for m in _TERM.finditer(text):
        while i < len(taken) and taken[i][0] < m.end():
            end = max(end, taken[i][1])
            i += 1
        if m.start() >= end:
            yield m[0].lower(), m.start(), m.end()


_SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = (
    "doc_id long, key binary, spans array<struct<kind:string,start:int,end:int>>, "
    "entities array<string>, terms array<string>, text string"
)


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]


def find_base(docs: DataFrame) -> DataFrame:
    """Base spans of every row; rows that hold an entity carry their entities, terms and text along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = texts(part.column(1))
            spans = [base_spans(t) for t in raw]
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([hashlib.sha256(t.encode()).digest() for t in raw], pa.binary()),
                pa.array([_rows(s) for s in spans], _SPAN_LIST),
                pa.array([sorted({entity(k, t[a:b]) for k, a, b in s}) for t, s in zip(raw, spans)], pa.list_(pa.string())),
                pa.array([sorted({w for w, _, _ in term_spans(t, s)}) if s else [] for t, s in zip(raw, spans)], pa.list_(pa.string())),
                pa.array([t if s else None for t, s in zip(raw, spans)], pa.string()),
            ], names=["doc_id", "key", "spans", "entities", "terms", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def term_rows(docs: DataFrame) -> DataFrame:
    """(term, rows): in how many rows of the corpus a term stands; counted in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in slices(batches):
            for t in texts(part.column(0)):
                counts.update(set(_TERM.findall(t.lower())))
            if len(counts) > FLUSH:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    return docs.select("text").mapInArrow(run, "term string, rows long").groupBy("term").agg(F.sum("rows").alias("rows"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "rows"]
    )


def disclosing_terms(docs: DataFrame, cases: DataFrame, limits: Disclosure) -> DataFrame:
    """(entity, term, action) of terms that reveal an entity; ``cases`` has a row per distinct text with its ``copies``."""
    held = cases.select("key", "copies", "terms", F.explode("entities").alias("entity"))
    known = held.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("entity_rows")).where(
        F.col("texts") >= limits.support
    )
    pairs = (
        held.join(known, "entity").select("entity", "entity_rows", "copies", F.explode("terms").alias("term"))
        .groupBy("entity", "entity_rows", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("both"))
        .where(F.col("texts") >= limits.support)
    )
    total = docs.agg(F.count("*").alias("total"))
    measured = pairs.join(term_rows(docs), "term").join(F.broadcast(total))  # one row
    content = F.log2(F.col("total") / F.col("entity_rows"))
    shared = F.log2(F.col("both") * F.col("total") / (F.col("rows") * F.col("entity_rows")))
    return measured.where(content > 0).withColumn("share", shared / content).where(F.col("share") >= limits.generalise).select(
        "entity", "term", F.when(F.col("share") >= limits.remove, "remove").otherwise("generalise").alias("action")
    )


def scan(docs: DataFrame, limits: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text): base spans, then terms to generalise or remove.

    A null or empty text has no spans.  Copies of a text share one look at its terms and do
    not count as support.  An entity needs ``support`` distinct texts before any term can
    reveal it.  Repeated or null ids and other columns do not matter; an empty table gives an
    empty result.
    """
    found = stored(find_base(docs), "found")
    cases = stored(
        found.where(F.size("entities") > 0).groupBy("key").agg(
            F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")
        ), "cases",
    )
    risky = stored(disclosing_terms(docs, cases, limits), "risky")
    wanted = (
        cases.select("key", F.explode("entities").alias("entity")).join(risky, "entity")
        .groupBy("key", "term").agg(F.max("action").alias("action"))
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            added = []
            for text, actions in zip(texts(part.column(1)), part.column(2).to_pylist()):
                by_term = dict(actions)
                spans = base_spans(text)
                added.append(_rows([(by_term[w], a, b) for w, a, b in term_spans(text, spans) if w in by_term]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(added, _SPAN_LIST)], names=["key", "added"])

    one_text = found.where("text is not null").join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "actions")
    added = one_text.mapInArrow(run, "key binary, added array<struct<kind:string,start:int,end:int>>")
    return found.select("doc_id", "key", "spans").join(added, "key", "left").select(
        "doc_id", F.when(F.col("added").isNull(), F.col("spans")).otherwise(F.concat("spans", "added")).alias("spans")
    )


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with base values named by kind, generalised terms by what they look like, and removed terms gone."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a < at:
            continue
        word = {"remove": "", "generalise": "<name>" if text[a].isupper() else "<word>"}.get(kind, f"<{kind}>")
        out += [text[at:a], word]
        at = b
    return "".join([*out, text[at:]])


def sanitised_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with the spans of ``found`` acted on; ids must be unique."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            clean = [
                sanitised(t, [(s["kind"], s["start"], s["end"]) for s in spans])
                for t, spans in zip(texts(part.column(1)), part.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").join(found, "doc_id").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, text string"
    )


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, the digest of the base spans and all spans, from the rows of ``scan``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            spans = [[(s["kind"], s["start"], s["end"]) for s in row] for row in part.column(1).to_pylist()]
            base = [[s for s in row if s[0] in KINDS] for row in spans]
            counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([
                part.column(0), *counts,
                pa.array([hashlib.sha256(joined(row, KINDS).encode()).hexdigest() for row in base], pa.string()),
                pa.array([joined(row, KINDS + ACTIONS) for row in spans], pa.string()),
            ], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")
