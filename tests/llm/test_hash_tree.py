"""The tree against plain loops over its shards, and its law of movement."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import hash_tree
from plumbline.llm.hash_tree import RANGE, Shard, mixed, tree

SCHEMA = "doc_id long, text string"


def expected_shard(key, shards):
    """Level by level in Python: region, then rack, then shard."""
    key = (-1 if key is None else key) % (1 << 64)
    hashed = mixed(mixed(key >> 32) ^ key % RANGE)
    draws = {s.number: math.log((mixed(hashed ^ mixed(s.number + 1)) + 1) / RANGE) / s.weight for s in shards if s.weight > 0}
    inside = [s for s in shards if s.weight > 0]
    for level in ("region", "rack", "number"):
        best = max(inside, key=lambda s: (draws[s.number], -getattr(s, level)))
        inside = [s for s in inside if getattr(s, level) == getattr(best, level)]
    return inside[0].number


def shards_of(spark, keys, shards):
    rows = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    return {r.doc_id: r.shard for r in hash_tree.placed(rows, shards).collect()}


def test_descent_against_plain_loops(spark):
    rng = random.Random(5)
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), *[rng.randrange(-(1 << 40), 1 << 40) for _ in range(300)]]
    for shards in (tree(1), tree(16), [Shard(3, 0, 0, 2.5), Shard(7, 0, 1, 1.0), Shard(9, 1, 2, 0.5), Shard(11, 1, 2, 0.0)]):
        assert shards_of(spark, keys, shards) == {k: expected_shard(k, shards) for k in keys}


def test_one_more_shard_takes_rows_only_into_itself():
    for n in range(1, 40):
        before = {k: expected_shard(k, tree(n)) for k in range(200)}
        after = {k: expected_shard(k, tree(n + 1)) for k in range(200)}
        assert all(after[k] in (before[k], n) for k in before)


def test_shares_follow_weights_and_moves_stay_with_the_changed_subtree(spark):
    before = [Shard(i, i // 4, i // 2, 1.0 + i % 3) for i in range(8)]
    after = [Shard(s.number, s.region, s.rack, s.weight * (2 if s.rack == 3 else 1)) for s in before]
    keys = range(40_000)
    first, then = shards_of(spark, keys, before), shards_of(spark, keys, after)
    for found, shards in ((first, before), (then, after)):
        counts, total = Counter(found.values()), sum(s.weight for s in shards)
        for s in shards:
            share = s.weight / total
            assert abs(counts[s.number] / 40_000 - share) < 5 * math.sqrt(share / 40_000)
    moved = [k for k in keys if first[k] != then[k]]
    assert moved and all(then[k] in (6, 7) for k in moved)


def test_no_weight_at_all(spark):
    with pytest.raises(ValueError):
        hash_tree.placed(spark.createDataFrame([(1,)], "doc_id long"), [Shard(0, 0, 0, 0.0)])


def test_assignment_of_odd_rows(spark):
    rows = [(None, "a"), (None, None), (4, ""), (4, "é" * 9), (4, ""), (7, "x" * 300_000), *[(9, "same")] * 500, *[(i, "t") for i in range(100, 400)]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({"shard": F.lit("clash"), "slot": F.lit(1), "size": F.lit(None)})
    got = hash_tree.assignment(docs, tree(16), tree(17)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert r.shard == expected_shard(r.doc_id, tree(16)) and r.grown_shard == expected_shard(r.doc_id, tree(17)) and r.law == "key"
        slots[r.shard].append((r.slot, r.doc_id is None, r.doc_id or 0, r.text_crc32))
    for own in slots.values():
        own.sort()
        assert [s for s, *_ in own] == list(range(len(own)))
        assert [rest for _, *rest in own] == sorted(rest for _, *rest in own)


def test_empty_table(spark):
    assert hash_tree.assignment(spark.createDataFrame([], SCHEMA), tree(16), tree(17)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], SCHEMA)
    plan = hash_tree.placed(docs, tree(16))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
