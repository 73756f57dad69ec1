"""Targets by a plain rule, words near them, and equal results for equal tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.common import stored
from plumbline.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, text string"


def plain_targets(sizes):
    """{source: target} from {source: size}: share by weight, fix those above their bound, share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return target


def check(rows, docs):
    """``docs`` is {doc_id: (source, text)} with unique ids."""
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        source, text = docs[r.doc_id]
        n = len((text or "").encode().split())
        assert r.size == n and 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        sizes[source] += n
        taken[source] += r.taken
        largest[source] = max(largest[source], n)
    target = plain_targets(sizes)
    for r in rows:
        source = docs[r.doc_id][0]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1, (s, taken[s], target[s])


def test_query(spark, sf_dir):
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(QUERIES["op7_source_mixing"](spark, sf_dir).collect(), docs)


def fixture(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}" if i % 3 else "hot", "w " * (i * 37 % 90)) for i in range(400)]
    rows += [(1000, "tiny", "one"), (1001, "blank", None), (1002, "blank", ""), (1003, "\U0001f600", "a b"), (1004, "￿", "a b c"), (1005, "big", "z " * 50_000)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_sources_of_all_kinds(spark):
    rows, docs = fixture(spark)
    docs = docs.withColumn("size", F.lit("clash")).withColumn("place", F.lit(1.5)).repartition(5)
    check(mixing.mixed(docs).collect(), {i: (s, t) for i, s, t in rows})


def test_reruns_agree_and_copies_are_made(spark):
    rows, docs = fixture(spark)
    one, two = ({r.doc_id: r.copies for r in mixing.mixed(d).collect()} for d in (docs, docs.repartition(3).orderBy(F.rand(4))))
    assert one == two and set(one.values()) >= {1, 2, 3}
    made = {r.doc_id: r.n for r in mixing.mixed_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert made == {i: n for i, n in one.items() if n}


def test_newton_meets_every_target(spark):
    cells = spark.createDataFrame([(p, s, n) for p in range(4) for s, n in ((0, 5), (3, 40), (50, 7), (900, 2))], "place long, size long, n long")
    total = 3 * 40 + 50 * 7 + 900 * 2
    sources = spark.createDataFrame(
        [(p, total, float(total) * share, total / 54, 3) for p, share in enumerate((0.01, 1.0, 2.9, 3.0))],
        "place long, source_size long, target double, mean_size double, least_size long",
    )
    state = mixing.balanced(stored(cells, "cells"), stored(sources, "sources"))
    words = cells.join(state, "place").groupBy("place", "target").agg(F.sum(F.col("n") * F.col("size") * mixing._rate(3)).alias("words"))
    for r in words.collect():
        assert r.words == pytest.approx(r.target, rel=1e-6)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x y")] * 4 + [(None, "b", "z")] * 2, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == 6 and abs(sum(r.taken for r in got) - 10) <= 2
    assert mixing.mixed(docs.limit(0)).count() == 0
