"""Base phrases against a plain search, and errors within and beyond the bound."""

import re

from pyspark.sql import functions as F

from plumbline.llm import license_search
from plumbline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_query_against_plain_search(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_license_search"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert sum(r.n_base for r in rows) > 0


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("score", F.lit("x")).withColumn("n_words", F.lit(1))
    return [r for _, r in sorted((r.doc_id, r) for r in license_search.scan(docs).collect())]


def test_overlaps_and_odd_texts(spark):
    texts = [
        "cc by nc cc by nc", "CC-BY-NC 4.0", None, "", "under the MIT License, apache license (version 2)", "sunder the mit license",
        "é by nc cc by nc", "a" * 300_000, "cc by " * 50_000 + "nc", "under the mit licenses",
    ]
    for t, r in zip(texts, scan(spark, texts)):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(t)


def test_errors_within_the_bound_are_found(spark):
    got = scan(spark, [
        "code is under the mit licence now", "under teh mit license", "under some quite other license",
        "Permission is hereby granted, free of charge, to any person obtaning a copy", "apache licence, version 2", "gnu general public licence",
    ])
    assert [r.labels for r in got] == ["mit", "mit", "", "mit", "apache-2", "gpl"]
    assert all(0.85 < r.score < 1 for r in got if r.labels) and got[2].score == 0
    span = got[0].spans[0]
    assert (span.label, span.first, span.last, span.edits) == ("mit", 2, 5, 1)


def test_every_text_within_the_bound_is_a_candidate():
    notice = license_search.Notice("under the mit license", "mit", 2)
    raw = notice.text
    for i in range(0, len(raw), 2):
        for j in range(i + 1, len(raw), 3):
            edited = raw[:i] + "x" + raw[i + 1:j] + raw[j + 1:]
            flat = " w " + edited + " w "
            if len(edited.split()) and "  " not in flat and not edited.startswith(" "):
                assert license_search.fuzzy(flat.encode(), notice), edited


def test_empty_table(spark):
    assert license_search.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_notices_side_by_side_are_all_reported(spark):
    got = scan(spark, [
        "under the mit licence under the mit license", "gnu general public licence gnu general public license",
        "under the mit license " * 3 + "x under the mit licens",
    ])
    assert [[(s.label, s.first, s.last, s.edits) for s in r.spans] for r in got[:2]] == [
        [("mit", 0, 3, 1), ("mit", 4, 7, 0)], [("gpl", 0, 3, 1), ("gpl", 4, 7, 0)],
    ]
    assert [(s.first, s.edits) for s in got[2].spans] == [(0, 0), (4, 0), (8, 0), (13, 1)]


def test_many_repeats_are_all_found_in_one_pass():
    notice = license_search.Notice("under the mit license", "mit", 2)
    flat = b" " + b"under the mit licence " * 20_000
    assert len(license_search.fuzzy(flat, notice)) == 20_000


def test_notices_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "All rights reserved by Example")], SCHEMA)
    row = license_search.scan(docs, labels={"all rights reserved by": "reserved"}).first()
    assert row.labels == "reserved" and [(s.first, s.last) for s in row.spans] == [(0, 3)]
