"""Exact groups against plain grouping, and the filters by themselves."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup
from plumbline.llm.exact_dedup import QuotientFilter

SCHEMA = "doc_id long, text string"


def test_filters_count_and_merge_without_loss():
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = [rng.choice(pool, n) for n in (0, 1, 300, 2000)]
    whole = QuotientFilter.merged([QuotientFilter.unpacked(*QuotientFilter.build(p).packed().values()) for p in parts])
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist())) == Counter(np.concatenate(parts).tolist())
    again = [s for _, s in whole.slices(12)]
    assert QuotientFilter.merged(again).fingerprints().tolist() == whole.fingerprints().tolist()
    assert all((np.diff(s.fingerprints().astype(object)) > 0).all() for s in again)


def test_groups_against_plain_grouping(spark):
    rng = random.Random(3)
    bodies = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 4))) for _ in range(60)]
    rows = [(i, rng.choice([b, " " + b, b + "\n\t", b.replace("a", "a ")])) for i, b in enumerate(bodies * 5)]
    rows += [(1000, None), (1001, "x" * 400_000), (1002, "x" * 400_000 + " ")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("keep_id", F.lit("clash")).withColumn("fingerprint", F.lit(1))
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    expected = {}
    for body, own in groups.items():
        for _, i in own:
            expected[i] = (min(own)[1], len(own), min(own)[1] == i, hashlib.sha256(body.encode()).hexdigest())
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == expected


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a "), (4, "b"), (4, "b"), (None, "b"), (9, "c")], SCHEMA)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()), key=str)
    assert got == sorted(
        [(None, None, 2, True), (None, None, 2, True), (4, 4, 3, True), (4, 4, 3, True), (None, 4, 3, False), (9, 9, 1, True)], key=str
    )


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
