"""Recall and exact scores against brute force, ties, and vectors that take no part."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import nearest
from plumbline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, query, k=20):
    scores = x @ x[ids == query][0]
    return sorted(((-s, i) for s, i in zip(scores, ids.tolist()) if i != query))[:k]


def test_query_has_recall_and_prunes(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in QUERIES["op8_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for query, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert abs(s - float(x[ids == i][0] @ x[ids == query][0])) < 1e-12
        hits += len({i for _, i, _ in found} & {i for _, i in brute(ids, x, query)})
    print("recall", hits / 20 / len(got))
    assert hits / 20 / len(got) >= 0.9


def test_most_vectors_are_not_verified_and_lengths_may_differ(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 32)) * rng.uniform(0.5, 2, (6000, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    how = replace(nearest.Search(), segment=2500, block=40)
    rows = nearest.search(frame, frame.where("vec_id % 60 = 0"), 10, how).collect()
    ids = np.arange(6000)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & {i for _, i in brute(ids, x, q, 10)}) for q in found)
    assert len(found) == 100 and hits >= 0.9 * 1000
    assert np.mean([r.verified for r in rows]) <= 0.5 * 2000


def test_ties_copies_and_faulty_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0])]
    rows += [(103, [float("inf"), 0.0, 0.0]), (104, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (60, [5.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("clash")).withColumn("length", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(frame, frame.where("vec_id in (0, 60, 100, 101, 103)"), 5).collect())
    assert got == [(0, 1, 60, 5.0), *[(0, i + 1, i, 1.25) for i in range(1, 5)], *[(60, i + 1, i, 5.0) for i in range(5)]]


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(20, [1.0, 2.0]), (3, [-1.0, -2.0])], SCHEMA)
    assert [tuple(r)[:4] for r in nearest.search(frame, frame.where("vec_id = 20")).collect()] == [(20, 1, 3, -5.0)]
    assert nearest.search(frame.limit(0), frame).count() == 0
    assert nearest.search(frame, frame.limit(0)).count() == 0


def test_vectors_of_another_dimension_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10, [9.0]), (11, [9.0, 9.0, 9.0]), (12, [])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(frame, frame.where("vec_id in (2, 10, 11)"), 2).collect())
    assert got == [(2, 1, 4, 9.0), (2, 2, 3, 7.0)]


def test_equal_vectors_of_any_numbers_tie():
    rng = np.random.default_rng(5)
    for n in range(3, 40):
        x = rng.standard_normal((n, 24))
        x[1::2] = x[1]
        segment = nearest.Segment(np.arange(n), x, float(np.sqrt((x ** 2).sum(axis=1)).max()), nearest.Search())
        for _, ids, scores, _ in segment.nearest(np.array([-1]), x[:1], n):
            odd = [s for i, s in zip(ids.tolist(), scores.tolist()) if i % 2]
            assert len(set(odd)) == 1
