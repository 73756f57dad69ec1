"""Fingerprints and components against brute force, and the odd rows."""

import random

import corpus_pipeline
import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import near_dedup
from plumbline.llm.components import components
from plumbline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=3):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    roots = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in docs}


def test_every_pair_within_three_bits_meets(spark):
    base = 0x0123456789ABCDEF
    near = [base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in ((0, 9, 17), (0, 9, 63), (33, 42, 63), (5, 30, 60))]
    values = [base, *near, base ^ 0xF]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    classes = spark.createDataFrame(rows, "node long, lane0 long")
    got = {(r.a, r.b) for r in near_dedup.candidate_links(classes, near_dedup.NARROW).collect()}
    assert got == {
        (i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3
    }


def test_a_large_group_of_near_copies_never_becomes_all_pairs(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join([*words[:i % 120], f"x{i}", *words[i % 120 + 1:]]) for i in range(300)] + ["other words altogether"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    plan = near_dedup.Plan(words=5, lanes=1, groups=(tuple(range(8)),), posting_bytes=2, max_bits=20)
    checked = []

    def counted(docs, links):
        checked.append(links.count())
        return near_dedup.verified_by_shingles(5, 0.8)(docs, links)

    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, plan, counted).collect()}
    assert got == {**{i: 0 for i in range(300)}, 300: 300}
    assert sum(checked) < 300 * 299 / 2 / 3
    assert checked[1] < 300


def test_heads_of_lists_change_no_component(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(200):
        text = [f"{i % 4}{w}" for w in words]
        for _ in range(rng.randrange(6)):
            text[rng.randrange(60)] = f"x{rng.randrange(10)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = near_dedup.Plan(words=5, lanes=1, groups=(tuple(range(8)),), posting_bytes=2, max_bits=14)
    verify = near_dedup.verified_by_shingles(5, 0.6)
    with_heads, without = (
        {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, plan, verify, crowd).collect()}
        for crowd in (2, 1000)
    )
    assert with_heads == without
    assert 4 < len(set(without.values())) < 200


def test_rare_shingles_spare_pairs_and_change_no_component(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        text = list(words)
        for _ in range(rng.choice((1, 4, 9))):
            text[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "one two"), (7, rows[7][1])], SCHEMA)
    plan = near_dedup.Plan(words=5, lanes=1, groups=(tuple(range(8)),), posting_bytes=2, max_bits=24, least_shared=2)
    pairs = {}

    def found(rare):
        pairs[rare] = []

        def counted(docs, links):
            pairs[rare].append(links.count())
            return near_dedup.verified_by_shingles(5, 0.8)(docs, links)

        got = near_dedup.near_duplicates(docs, plan, counted, 8, near_dedup.rare_shingles(5, 0.8) if rare else None)
        return {r.doc_id: r.component_id for r in got.collect()}

    assert found(True) == found(False)
    assert pairs[True][1] < pairs[False][1]


def test_rare_shingles_meet(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i x"), (3, "p q r s t u v w y z"), (4, None)], SCHEMA
    )
    rows = near_dedup.rare_shingles(1, 0.8)(docs, docs.select(F.col("doc_id").cast("long").alias("node"))).collect()
    of = {n: {r.shingle for r in rows if r.node == n} for n in (1, 2, 3, 4)}
    assert [len(of[n]) for n in (1, 2, 3, 4)] == [3, 3, 3, 0]
    assert of[1] & of[2] and not of[1] & of[3]


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "One"), (6, "oNE"), (6, "oNE"), (None, "one"), (7, "word " * 200_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lane0", F.lit("clash")).withColumn("component_id", F.lit(1.5))
    got = sorted(
        ((r.doc_id, r.lane0, r.component_id) for r in near_dedup.near_duplicates(docs).collect()), key=str
    )
    one = plain_fingerprint("one")
    one = one - (1 << 64) if one >> 63 else one
    many = plain_fingerprint("word word word")
    many = many - (1 << 64) if many >> 63 else many
    assert got == sorted(
        [(3, 0, 3), (5, 0, 3), (9, 0, 3), (4, one, 4), (6, one, 4), (6, one, 4), (None, one, 4), (7, many, 7)], key=str
    )


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def test_verification_keeps_only_similar_texts(spark):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[:50]))], SCHEMA
    )
    links = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    got = near_dedup.verified_by_shingles(5, 0.8)(docs, links).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_equal_fingerprints_are_checked_by_their_shingles(spark):
    line = [f"r{i}" for i in range(7)]

    def text(*own):
        return " ".join([*line * 130, *own])

    own = [[f"d{k}x{i}" for i in range(150)] for k in range(3)]
    texts = [text(*own[0]), text(*own[1]), text(*own[2]), text(*own[1][:-1], "other")]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    plan = near_dedup.Plan(
        words=5, lanes=3, groups=tuple(tuple(range(8 * i, 8 * i + 8)) for i in range(3)), posting_bytes=2, max_bits=50, least_shared=2
    )
    assert len({tuple(near_dedup.fingerprint(t.encode(), 5, 3)) for t in texts}) == 1
    verify, rare = near_dedup.verified_by_shingles(5, 0.8), near_dedup.rare_shingles(5, 0.8)
    for crowd in (2, 32):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, plan, verify, crowd, rare).collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 1}


def test_copies_that_repeat_a_line_more_often_meet(spark):
    texts = []
    for k in range(20):
        own, line = [f"d{k}x{i}" for i in range(300)], [f"r{k}x{i}" for i in range(10)]
        texts += [" ".join([*own, *line * 2]), " ".join([*own, *line * 60])]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    words, least = corpus_pipeline.WIDE.words, corpus_pipeline.SIMILARITY
    found = near_dedup.near_duplicates(
        docs, corpus_pipeline.WIDE, near_dedup.verified_by_shingles(words, least), rare=near_dedup.rare_shingles(words, least)
    )
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i - i % 2 for i in range(40)}


def test_pairs_at_the_least_similarity_meet():
    plan, rng, missed, pairs = corpus_pipeline.WIDE, random.Random(3), 0, 1000
    for _ in range(pairs):
        words = [f"{rng.random()}" for _ in range(304)]  # 300 shingles, 267 of them in both texts
        prints = [
            near_dedup.fingerprint(" ".join([*words[:271], *own]).encode(), plan.words, plan.lanes, plan.distinct)
            for own in (words[271:], [f"{rng.random()}" for _ in range(33)])
        ]
        differing = [(a ^ b) & (2**64 - 1) for a, b in zip(*prints)]
        shared = max(sum((d >> 8 * i & 255) == 0 for i in range(8)) for d in differing)
        missed += shared < plan.least_shared or sum(d.bit_count() for d in differing) > plan.max_bits
    assert missed <= 0.015 * pairs, missed


def test_sizes_and_parities_never_rule_out_a_similar_pair(spark):
    """Made pairs of every similarity: all of 0.8 and more may be alike, of those below 0.6 hardly any."""
    rng, rows, alike = np.random.default_rng(5), [], {}
    for i in range(600):
        n = int(rng.integers(1, 600))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        kept = a[: int(n * rng.uniform(0.3, 1))]
        b = np.unique(np.r_[kept, rng.integers(0, 2**63, int(rng.uniform(0, 0.3) * n)).astype(np.uint64)])
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        alike[i] = common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0
        rows.append((i, len(a), *near_dedup.parities(a), len(b), *near_dedup.parities(b)))
    names = ["shingle_count", *near_dedup.PARITY_COLUMNS]
    made = spark.createDataFrame(rows, ["i", *[f"l_{c}" for c in names], *[f"r_{c}" for c in names]])
    found = {r.i for r in made.where(near_dedup._can_be_alike(0.8)).select("i").collect()}
    assert {i for i, s in alike.items() if s >= 0.8} <= found
    low = [i for i, s in alike.items() if s < 0.6]
    assert len(low) > 100 and len(found & set(low)) <= 0.05 * len(low)


def test_a_pair_leaves_the_join_at_its_first_common_shingle(spark):
    """Texts of one large group: the pairs of the join over rare shingles, before they are made distinct."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, 1 + i % 3, replace=False):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("node"))
    rare = near_dedup.rare_shingles(5, 0.8)(docs, nodes).collect()
    held = {}
    for r in rare:
        held.setdefault(r.shingle, []).append(r)
    emitted = [
        (x.node, y.node) for own in held.values() for x in own for y in own
        if x.node < y.node and next(iter([s for s in x.carried if s in y.carried]), x.shingle) == x.shingle
    ]
    met = {(x.node, y.node) for own in held.values() for x in own for y in own if x.node < y.node}
    assert set(emitted) == met and len(emitted) <= 1.2 * len(met)
    sets = [set(near_dedup.shingles(t.encode(), 5)) for t in texts]
    expected = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert expected <= met
    got = near_dedup.near_duplicates(
        docs, corpus_pipeline.WIDE, near_dedup.verified_by_shingles(5, 0.8), 8, near_dedup.rare_shingles(5, 0.8)
    )
    root = list(range(60))
    for _ in range(60):
        for a, b in expected:
            root[a] = root[b] = min(root[a], root[b])
    assert expected and {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root))


def test_groups_of_postings_are_joined_one_at_a_time(spark, monkeypatch):
    """The rows of postings that are dealt at once are those of one group, and all pairs of shared postings are found."""
    rng, plan = random.Random(12), corpus_pipeline.WIDE
    prints = [[rng.getrandbits(64) for _ in range(plan.lanes)] for _ in range(30)]
    for own in prints[:30]:
        near = list(own)
        for _ in range(rng.choice((5, 20, 60))):
            near[rng.randrange(plan.lanes)] ^= 1 << rng.randrange(64)
        prints.append(near)
    rows = [(i, *[x - (1 << 64) if x >> 63 else x for x in own]) for i, own in enumerate(prints)]
    classes = spark.createDataFrame(rows, "node long, " + ", ".join(f"lane{i} long" for i in range(plan.lanes)))
    postings, sizes = near_dedup._postings, []

    def counted(*given):
        made = postings(*given)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(near_dedup, "_postings", counted)
    none = spark.createDataFrame([], "node long, shingle long, ahead long")
    found = {(r.a, r.b) for r in near_dedup.candidate_links(classes, plan, 1000, lambda nodes: none).collect()}

    def linked(p, q):
        differing = [a ^ b for a, b in zip(p, q)]
        same = [sum((d >> 8 * i & 255) == 0 for i in range(8)) for d in differing]
        return max(same) >= 2 and sum(d.bit_count() for d in differing) <= plan.max_bits

    assert found == {(a, b) for a in range(60) for b in range(a + 1, 60) if linked(prints[a], prints[b])} and len(found) >= 20
    assert sizes == [60 * 28] * 4


def test_rows_of_rare_shingles_grow_with_the_table(spark, monkeypatch):
    """Five times the texts: all of them meet at their rare shingles at both sizes, however full the postings are."""
    sizes, shared_shingles = [], near_dedup.shared_shingles
    verify, rare = near_dedup.verified_by_shingles(5, 0.8), near_dedup.rare_shingles(5, 0.8)

    def counted(placed):
        sizes.append(placed.count())
        return shared_shingles(placed)

    def no_postings(*given):
        raise AssertionError("postings were made")

    monkeypatch.setattr(near_dedup, "shared_shingles", counted)
    monkeypatch.setattr(near_dedup, "_postings", no_postings)
    for n in (60, 300):
        texts = [" ".join(f"d{i // 2}x{j}" for j in range(80 - i % 2)) for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
        got = near_dedup.near_duplicates(docs, corpus_pipeline.WIDE, verify, 32, rare)
        assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i in range(n)}
    assert sizes[1] == 5 * sizes[0]


def test_the_short_condition_is_that_of_the_postings(spark):
    """Bytes compared without taking them one by one, over plans with groups of a lane and of half a lane."""
    rng = random.Random(21)
    halves = near_dedup.Plan(words=3, lanes=2, groups=((0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11), (12, 13, 14, 15)), posting_bytes=2, max_bits=40)
    for plan in (corpus_pipeline.WIDE, halves, near_dedup.NARROW):
        rows = []
        for i in range(400):
            left = [rng.getrandbits(64) for _ in range(plan.lanes)]
            right = list(left)
            for _ in range(rng.randrange(2 * plan.max_bits)):
                right[rng.randrange(plan.lanes)] ^= 1 << rng.randrange(64)
            rows.append((i, *[near_dedup._long(x) for x in (*left, *right)]))
        names = [f"{side}_lane{k}" for side in "lr" for k in range(plan.lanes)]
        close, first = near_dedup._compared(plan)
        made = spark.createDataFrame(rows, ", ".join(["i long", *[f"{c} long" for c in names]]))
        got = made.select((close & first.isNotNull()).alias("old"), near_dedup._close(plan).alias("new")).collect()
        assert all(r.old == r.new for r in got) and 20 < sum(r.old for r in got) < 400


def test_cells_are_counted_over_all_tasks(spark):
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(60)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], SCHEMA).repartition(5)
    expected = np.zeros(near_dedup.CELLS, dtype=np.int64)
    for t in texts:
        np.add.at(expected, (np.unique(near_dedup.hashes(t.encode(), 5)) & np.uint64(near_dedup.CELLS - 1)).astype(np.int64), 1)
    assert (near_dedup.cell_counts(docs, 5) == expected).all()
    assert not near_dedup.cell_counts(docs.limit(0), 5).any()
