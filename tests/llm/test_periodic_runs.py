"""Runs against plain comparison of every period, and the query against a restatement of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import periodic_runs
from plumbline.llm.periodic_runs import Shape, Suffixes, recurring, runs, text_runs

SCHEMA = "doc_id long, text string"


def expected_runs(words, least=24, times=3):
    """Every stretch with every period, the smallest period by trying all."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                length, own = i - start + q, words[start:i + q]
                smaller = any(own[d:] == own[:-d] for d in range(1, q))
                if length >= max(least, times * q) and not smaller:
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_words(rng):
    n, alphabet = rng.randint(0, 160), rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 10 else 0):
        p, s = rng.randint(1, 12), rng.randrange(n)
        for i in range(s, min(n, s + p * rng.randint(2, 9) + rng.randint(0, p))):
            words[i] = words[s + (i - s) % p]
    return words


def test_runs_against_plain_comparison():
    rng = random.Random(1)
    some = 0
    for _ in range(1500):
        words = made_words(rng)
        expected = expected_runs(words)
        some += len(expected)
        assert runs(words) == expected
        assert text_runs([b"w%d" % w for w in words]) == expected
        assert runs(words, Shape(30, 4)) == expected_runs(words, 30, 4)
    assert some > 500


def test_squares_come_from_the_last_earlier_end():
    """Each reported distance has the exact common suffix, and no square of a smallest period is missed."""
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(40)]
        suffixes = Suffixes(len(words))
        for i, w in enumerate(words):
            for distance, common in suffixes.append(w):
                same = 0
                while same <= i - distance and words[i - same] == words[i - distance - same]:
                    same += 1
                assert common == same >= distance
    suffixes = Suffixes(12)
    assert [suffixes.append(w) for w in (1, 2, 1, 2, 2)] == [[], [], [], [(2, 2)], [(1, 1)]]


def test_equal_hashes_lose_nothing():
    words = list(range(40)) + [1, 2, 3] * 9 + list(range(50))
    assert recurring(np.zeros(len(words), dtype=np.uint64)) == [(0, len(words))]
    assert recurring(np.arange(200, dtype=np.uint64)) == [] == recurring(np.zeros(23, dtype=np.uint64))


def test_shapes_that_windows_cannot_find_are_refused():
    with pytest.raises(ValueError):
        Shape(words=23)
    with pytest.raises(ValueError):
        Shape(times=2)


def test_long_texts_of_few_words():
    words = [i % 7 for i in range(30_000)] + list(range(100, 20_000)) + [3, 4] * 5_000
    assert runs(words) == [(0, 30_000, 7), (49_900, 10_000, 2)]
    fibonacci, more = [0], [0, 1]
    while len(more) < 5_000:
        fibonacci, more = more, more + fibonacci
    assert len(runs(more)) > 100


def expected_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = expected_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_digests_against_the_contract(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [rng.choice(["a", "B", "été", "x-1", " ", "\x1f"]) + str(w) for w in made_words(rng)]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t\x0b ", "\r\x0c"]) for w in words)))
    rows += [(900, None), (901, ""), (902, " \n "), (None, "ab " * 50), (None, None), (903, "one"), (904, "z " * 24), (904, "z " * 24), (905, "z " * 23)]
    rows += [(i, "again " * 9) for i in range(-40, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({"runs": F.lit("clash"), "start": F.lit(1)})
    found = periodic_runs.digests(periodic_runs.detect(periodic_runs.planted(docs)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str(expected_row(*r)) for r in rows)


def test_query_on_whole_texts(spark):
    from plumbline.llm.queries import op13_periodic_runs

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 6_000}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and sum(r[1] > 0 for r in got.values()) > 10
    assert {i: got[i] for i in short} == {i: expected_row(i, t) for i, t in short.items()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.digests(periodic_runs.detect(periodic_runs.planted(docs))).count() == 0
