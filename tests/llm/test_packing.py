"""Every id once, no gap, no overlap, and about as few sequences as there can be."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.queries import QUERIES, TOKENIZER


def check(bins, histogram, limit):
    seen = defaultdict(int)
    for content, many in bins:
        assert many > 0 and sum(l * k for l, k in content.items()) <= limit
        for l, k in content.items():
            seen[l] += k * many
    assert dict(seen) == {l: n for l, n in histogram.items() if n}
    return sum(n for _, n in bins)


def bound(histogram, limit):
    return max(-(-sum(l * n for l, n in histogram.items()) // limit), sum(n for l, n in histogram.items() if 2 * l > limit))


@pytest.mark.parametrize("seed", range(4))
def test_few_sequences_for_many_shapes(seed):
    rng = np.random.default_rng(seed)
    shapes = [rng.integers(1, 1025, 3_000), rng.geometric(1 / 150, 20_000).clip(1, 1024), np.full(1_000, 300), rng.choice([513, 512, 341, 257, 9], 5_000)]
    lengths, counts = np.unique(shapes[seed], return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    used = check(packing.solve(histogram), histogram, 1024)
    best = bound(histogram, 1024)
    if seed == 2:
        best = 334
    if seed == 3:  # a 513 goes with no 512, and three of the next two lengths fill a sequence
        n = histogram
        best = n[513] + n[512] // 2 + (n[341] + n[257] - n[513]) // 3
    assert used <= 1.01 * best + 1, (used, best)


def test_small_cases_are_packed_as_well_as_can_be():
    assert check(packing.solve({6: 2, 4: 2, 5: 2}, 10), {6: 2, 4: 2, 5: 2}, 10) == 3
    assert check(packing.solve({7: 3, 3: 1, 2: 3}, 10), {7: 3, 3: 1, 2: 3}, 10) == 4
    assert packing.solve({}) == [] and check(packing.solve({1024: 5}), {1024: 5}, 1024) == 5


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "middling"])
def test_the_program_places_nearly_all_of_a_million_pieces(shape):
    rng = np.random.default_rng(1)
    x = {
        "uniform": lambda: rng.integers(1, 1024, 1_000_000), "lognormal": lambda: rng.lognormal(5.5, 0.9, 1_000_000).astype(int).clip(1, 1023),
        "middling": lambda: rng.integers(300, 800, 1_000_000),
    }[shape]()
    lengths, counts = np.unique(x, return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    covered = sum(l * k * n for content, n in packing.fractional(histogram, 1024, packing.Program()) for l, k in content.items())
    assert 0.99 * x.sum() <= covered <= x.sum() + 1e-3
    plain = check(packing.best_fit([], dict(histogram), 1024), histogram, 1024)
    assert check(packing.solve(histogram), histogram, 1024) <= plain


def test_table_of_fillings_against_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths, values = np.sort(rng.choice(np.arange(1, 12), 4, replace=False)), rng.random(4)
        best, last = packing.best_values(lengths, values, 17)
        every = [ks for ks in np.ndindex(*(17 // lengths + 1)) if np.dot(lengths, ks) <= 17]
        for first in range(4):
            found, empty = packing.configuration(first, lengths, last, 17)
            assert sum(lengths[at] * n for at, n in found.items()) + empty == 17
            most = max(np.dot(values, ks) for ks in every if ks[first])
            assert abs(sum(values[at] * n for at, n in found.items()) - most) < 1e-9
        assert abs(best[17] - max(np.dot(values, ks) for ks in every)) < 1e-9


def test_knapsack_against_all_subsets():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        values, supply = rng.random(4), rng.integers(1, 4, 4)
        found = packing.best_configuration(lengths, values, supply, 17)
        by = dict(zip(lengths.tolist(), values.tolist()))
        best = max(
            sum(v * k for v, k in zip(values, ks)) for ks in np.ndindex(*(supply + 1)) if np.dot(lengths, ks) <= 17
        )
        assert abs(sum(by[l] * k for l, k in found.items()) - best) < 1e-9
        assert all(k <= supply[list(lengths).index(l)] for l, k in found.items())


def whole(rows, docs, ids_of):
    """Checks pieces and places; gives the number of sequences."""
    at, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids, own = [*ids_of(text), 2], sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        assert all(r.length == 1024 for r in own[1:])
        end = 0
        for r in own:
            assert r.start == end
            end += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:end], dtype="<u4").tobytes())
        assert end == len(ids)
    return len(at)


@pytest.fixture(scope="module")
def ids_of():
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_query(spark, sf_dir, ids_of):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_best_fit_packing"](spark, sf_dir).collect()
    used = whole(rows, docs, ids_of)
    best = bound(Counter(r.length for r in rows), 1024)
    print("sequences", used, "bound", best)
    assert used <= 1.01 * best + 1


def test_nulls_repeats_and_long_texts(spark, ids_of):
    rows = [(1, None), (2, ""), (3, "x y " * 40_000), (4, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("length", F.lit(1))
    assert whole(packing.packed(docs, TOKENIZER).collect(), dict(rows), ids_of)
    twice = docs.union(docs).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert packing.packed(twice, TOKENIZER).count() == 2 * packing.packed(docs, TOKENIZER).count() + 1
    assert packing.packed(docs.limit(0), TOKENIZER).count() == 0
