"""Held-out accuracy, the optimiser, and the odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality
from plumbline.llm.queries import QUERIES

LABELS = "doc_id long, quality int"


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op6_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    scores, labels = np.array([r.score for r in held]), np.array([r.quality for r in held])
    hits = np.mean([r.predicted == r.quality for r in held])
    print("auc", auc(scores, labels), "hits", hits, "good kept", np.mean([r.predicted for r in held if r.quality == 1]))
    assert auc(scores, labels) > 0.97
    assert hits > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"word {'good' if i % 3 else 'bad !!'} w{i}") for i in range(60)], "doc_id long, text string")
    labels = [(i, int(i % 3 > 0)) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    one, two = (quality.train(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert (one == two).all() and one.any()


def test_odd_rows(spark):
    rows = [(1, "good text"), (1, "good text"), (2, None), (3, ""), (None, "good text"), (4, "bad " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (3, 7)], LABELS)
    got = quality.classify(docs, labels).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(got) == 6 and all(len(s) == 1 and 0 <= min(s) <= 1 for s in by_id.values())
    assert by_id[2] == by_id[3] and by_id[None] == by_id[1]
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_blocks_do_not_change_features(monkeypatch):
    text = b"one two, three two one !! " * 50
    whole = quality.features(text, 18)
    monkeypatch.setattr(quality, "BLOCK", 7)
    parts = quality.features(text, 18)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_an_id_on_many_rows_counts_once(spark):
    rows = [(1, f"text w{i}") for i in range(500)] + [(4, "bad one")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (4, 0)], LABELS)
    weights = quality.train(docs, labels, quality.Training(max_rows=2, l1=0.0))
    assert 0 < np.count_nonzero(weights) <= 8
    assert (weights == quality.train(docs.repartition(5), labels, quality.Training(max_rows=2, l1=0.0))).all()
