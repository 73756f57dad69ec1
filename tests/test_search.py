"""Similarity search against brute force, and embeddings."""

import numpy as np
import pytest

from plumbline.operators import embedding, memory, similarity

NAMES = dict(query_id="id", query_vector="v", corpus_id="id", corpus_vector="v")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, v array<float>")


def brute(queries, corpus, k):
    out = {}
    for qid, q in queries:
        scored = []
        for cid, c in corpus:
            a, b = np.asarray(q, np.float32).astype(float), np.asarray(c if c is not None else [0] * len(q), np.float32).astype(float)
            length = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            score = None if length == 0 else round(float((a * b).sum() / length), 9)
            scored.append((score is None, -(score or 0), cid, score))
        out[qid] = [(c, s) for _, _, c, s in sorted(scored)[:k]]
    return out


def got(df):
    rows = sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"]))
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["match_id"], r["similarity"]))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [c for c, _ in a[q]] == [c for c, _ in b[q]], q
        for (_, s), (_, t) in zip(a[q], b[q]):
            assert (s is None) == (t is None) and (s is None or abs(s - t) < 1e-6)


@pytest.mark.parametrize("inline", [1000, 0])
@pytest.mark.parametrize("clusters", [1, 6])
def test_exact_plans_equal_brute_force(spark, inline, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.standard_normal((clusters, 8)) * 4
    # Every third row is a copy of one vector: the hot cell.
    corpus = [(i, centres[0] if i % 3 == 0 else centres[i % clusters] + rng.standard_normal(8)) for i in range(240)]
    queries = corpus[::7]
    found = similarity.vector_topk(vectors(spark, queries), vectors(spark, corpus), k=4, max_inline=inline,
                                   block_rows=25, pivots=9, **NAMES)
    same(got(found), brute(queries, corpus, 4))


@pytest.mark.parametrize("inline", [1000, 0])
def test_vectors_without_length_come_last(spark, inline):
    corpus = [(5, [0, 0]), (1, [1, 0]), (4, None), (2, [0, 1]), (3, [0, 0])]
    queries = [(10, [1, 1]), (11, [0, 0])]
    found = similarity.vector_topk(vectors(spark, queries), vectors(spark, corpus), k=4, max_inline=inline, **NAMES)
    assert got(found) == {10: [(1, pytest.approx(0.7071067812)), (2, pytest.approx(0.7071067812)), (3, None), (4, None)],
                          11: [(1, None), (2, None), (3, None), (4, None)]}


@pytest.mark.parametrize("inline", [1000, 0])
def test_empty_sides(spark, inline):
    some, none = vectors(spark, [(1, [1, 0])]), vectors(spark, [])
    assert similarity.vector_topk(none, some, max_inline=inline, **NAMES).count() == 0
    assert similarity.vector_topk(some, none, max_inline=inline, **NAMES).count() == 0


def test_approximate_recall_and_share(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    queries = corpus.where("id % 10 = 0")
    exact = got(similarity.vector_topk(queries, corpus, **NAMES))
    index = similarity.vector_codes(corpus, "id", "v")
    near = got(similarity.approximate_topk(queries, index, corpus, **NAMES))
    hits = sum(len({c for c, _ in exact[q]} & {c for c, _ in near[q]}) for q in exact)
    assert hits / (3 * len(exact)) >= 0.9
    assert 30 / corpus.count() <= 0.2


def test_approximate_search_skips_vectors_without_length(spark):
    corpus = vectors(spark, [(1, [1, 0]), (2, None), (3, [0, 0]), (4, [1, 1])])
    index = similarity.vector_codes(corpus, "id", "v")
    found = similarity.approximate_topk(vectors(spark, [(9, [1, 0])]), index, corpus, **NAMES)
    assert got(found) == {9: [(1, 1.0), (4, pytest.approx(0.7071067812))]}


def test_embeddings_are_repeatable_and_bounded(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, t string")
    made = {r["id"]: r["embedding"] for r in embedding.embed(rows, "t").collect()}
    assert made[1] == made[2] != made[3] and made[4] is None
    assert len(made[1]) == 1024 and max(map(abs, made[1])) <= 0.1000001


def test_a_failing_model_is_a_column(spark):
    def load():
        def fail(texts):
            raise RuntimeError("model away")
        return fail

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    found = {r["id"]: (r["embedding"], r["embedding_error"]) for r in embedding.embed(rows, "t", load).collect()}
    assert found == {1: (None, "model away"), 2: (None, None)}


def test_one_bad_text_stands_alone(spark):
    def load():
        def run(texts):
            if "bad" in texts:
                raise RuntimeError("cannot read it")
            return [[float(len(t))] for t in texts]
        return run

    rows = spark.createDataFrame([(i, "bad" if i in (3, 77) else "x" * i) for i in range(100)], "id int, t string").coalesce(1)
    found = {r["id"]: (r["embedding"], r["embedding_error"]) for r in embedding.embed(rows, "t", load, batch_rows=64).collect()}
    assert found == {i: (None, "cannot read it") if i in (3, 77) else ([float(i)], None) for i in range(100)}


def test_hashed_words_tell_texts_apart(spark):
    one, two, none, same = embedding.hashed_words(["meters per day", "peaks per month", " ", "Meters, per day"])
    assert abs(float((one * one).sum()) - 0.01) < 1e-6 and (one == same).all() and not none.any()
    assert float((one * two).sum()) < 0.005


def test_memory_remembers_and_finds(spark):
    schema = "run_id string, table_id string, business_description string, parsing_failed boolean, updated_at int"
    first = memory.remember(spark.createDataFrame([
        ("r1", "d.a", "meters", False, 1), ("r2", "d.a", None, True, 2), ("r3", "d.a", "meters again", False, 3),
        ("r1", "d.b", "peaks", None, 1),
    ], schema), spark.createDataFrame([("d.b", 7)], "table_id string, version bigint")).cache()
    assert sorted((r["table_id"], r["version"], r["embedding"] is None) for r in first.collect()) == [
        ("d.a", 1, False), ("d.a", 2, True), ("d.a", 3, False), ("d.b", 8, False)]
    asked = spark.createDataFrame([("d.a",), ("d.x",)], "table_id string")
    found = memory.prior_understandings(asked, first)
    assert "embedding" not in found.columns
    assert sorted((r["asked_table_id"], r["rank"]) for r in found.collect()) == [
        (t, i) for t in ("d.a", "d.x") for i in (1, 2, 3)]

    def away():
        def fail(texts):
            raise RuntimeError("away")
        return fail

    warned = memory.prior_understandings(asked, first, away).collect()
    assert {(r["asked_table_id"], r["warning"]) for r in warned} == {
        ("d.a", "vector search unavailable: away"), ("d.x", "vector search unavailable: away")}


def test_embedded_texts(spark):
    known = spark.createDataFrame([("d.t", "meters"), ("d.u", None)], "table_id string, business_description string")
    assert [r["embedding_text"] for r in embedding.understanding_texts(known).collect()] == ["d.t: meters", "d.u: "]
    assert embedding.query_texts(known).first()["embedding_text"] == "data table named d.t"


def test_a_query_leaves_once_for_a_group_of_cells(spark):
    rng = np.random.default_rng(8)
    apart = rng.standard_normal((40, 16))
    sizes = np.full(40, 10)
    group = similarity._groups(apart, sizes, 100)
    # Whatever the number of cells, a group is nearly full, and no cell is lost.
    assert sorted(np.bincount(group).tolist()) == [10] * 4
    corpus = [(i, rng.standard_normal(16)) for i in range(400)]
    found = similarity.vector_topk(vectors(spark, corpus), vectors(spark, corpus), k=3, max_inline=0, pivots=40, block_rows=100, **NAMES)
    same(got(found), brute(corpus, corpus, 3))


def test_batches_are_held_against_pivots_in_steps():
    batch = similarity.pa.RecordBatch.from_arrays([similarity.pa.array(range(2000))], names=["id"])
    steps = list(similarity._steps([batch]))
    assert max(s.num_rows for s in steps) == similarity.STEP_ROWS
    assert [i for s in steps for i in s.column("id").to_pylist()] == list(range(2000))
