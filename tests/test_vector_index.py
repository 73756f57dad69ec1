"""The stored index against exact search: recall, share of pairs, skipped files, odd vectors."""

import duckdb
import numpy as np
import pytest

from plumbline.operators import similarity, vector_index
from plumbline.workload import texts

NAMES = dict(query_id="id", query_vector="v")
EXACT = dict(**NAMES, corpus_id="id", corpus_vector="v")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


def found(df):
    return sorted((r["query_id"], r["rank"], r["match_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    corpus = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v")
    path = f"{tmp_path_factory.mktemp('index')}/i"
    assert vector_index.build(corpus, path, corpus_id="id", corpus_vector="v") == 64
    return corpus, path


def test_recall_within_a_fifth_of_the_pairs(spark, written):
    corpus, path = written
    queries = corpus.where("id % 10 = 0")
    exact = {x[::2] for x in found(similarity.vector_topk(queries, corpus, **EXACT))}
    near = {x[::2] for x in found(vector_index.search(queries, path, **NAMES))}
    assert len(exact & near) >= 0.9 * len(exact)
    cost = vector_index.cost(queries, path, **NAMES).first()
    assert cost["queries"] == queries.count() and 0.05 < cost["share"] <= 0.2


def test_every_cell_gives_the_exact_result(spark, written):
    corpus, path = written
    queries = corpus.where("id % 97 = 0")
    exact = similarity.vector_topk(queries, corpus, **EXACT)
    assert found(vector_index.search(queries, path, probes=10_000, **NAMES)) == found(exact)


def test_one_query_reads_the_folders_it_probes(spark, written):
    corpus, path = written
    one = vector_index.search(corpus.where("id = 7"), path, probes=2, **NAMES)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(cell") + plan.count("PartitionFilters: [cell") >= 2
    assert one.where("rank = 1").first()["match_id"] == 7
    share = vector_index.cost(corpus.where("id = 7"), path, probes=2, **NAMES).first()["share"]
    assert share < 0.1


def test_blocks_do_not_change_the_result(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    # Every third row is a copy of one vector: a hot cell, on both sides.
    rows = [(i, [1, 1, 0, 0, 0, 0] if i % 3 == 0 else rng.standard_normal(6)) for i in range(300)]
    corpus = vectors(spark, rows)
    vector_index.build(corpus, f"{tmp_path}/i", corpus_id="id", corpus_vector="v", cells=5)
    whole = found(vector_index.search(corpus, f"{tmp_path}/i", k=4, probes=5, **NAMES))
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 17)
    assert found(vector_index.search(corpus, f"{tmp_path}/i", k=4, probes=5, **NAMES)) == whole
    assert whole == found(similarity.vector_topk(corpus, corpus, k=4, **EXACT))


def test_odd_vectors_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    corpus = vectors(spark, [(1, [1, 0]), (2, None), (3, [0, 0]), (4, [1, 1]), (5, [nan, 1]), (6, [inf, 1]), (7, [1, 2, 3]), (8, []), (9, [1, 1])])
    vector_index.build(corpus, f"{tmp_path}/i", corpus_id="id", corpus_vector="v", cells=2)
    asked = vectors(spark, [(10, [2, 2]), (11, [0, 0]), (12, None), (13, [1, 2, 3]), (14, [nan, 0])])
    assert found(vector_index.search(asked, f"{tmp_path}/i", k=9, probes=2, **NAMES)) == [(10, 1, 4), (10, 2, 9), (10, 3, 1)]


def test_empty_tables(spark, tmp_path):
    none, some = vectors(spark, []), vectors(spark, [(1, [1, 0])])
    assert vector_index.build(none, f"{tmp_path}/n", corpus_id="id", corpus_vector="v") == 0
    assert vector_index.search(some, f"{tmp_path}/n", **NAMES).count() == 0
    vector_index.build(some, f"{tmp_path}/s", corpus_id="id", corpus_vector="v")
    assert vector_index.search(none, f"{tmp_path}/s", **NAMES).count() == 0
    assert vector_index.cost(none, f"{tmp_path}/s", **NAMES).first().asDict() == {"queries": 0, "pairs": 0, "share": None}


def test_recall_holds_where_rows_are_many_for_a_cell(spark, tmp_path):
    rows = np.random.default_rng(5).standard_normal((20_000, 64))
    corpus = vectors(spark, enumerate(rows))
    vector_index.build(corpus, f"{tmp_path}/i", corpus_id="id", corpus_vector="v")
    queries = corpus.where("id % 100 = 0")
    exact = {x[::2] for x in found(similarity.vector_topk(queries, corpus, **EXACT))}
    near = {x[::2] for x in found(vector_index.search(queries, f"{tmp_path}/i", **NAMES))}
    assert len(exact & near) >= 0.95 * len(exact)
    assert vector_index.cost(queries, f"{tmp_path}/i", **NAMES).first()["share"] <= 0.2


def test_a_query_leaves_a_folder_with_its_candidates_once(spark, written):
    corpus, path = written
    index = vector_index.Index(spark, path)
    routed = index.route(corpus.where("id % 100 = 0").selectExpr("id", "v AS vector"), vector_index.MAX_CELLS, 1.0)
    # Not a row for each of the 500 cells.
    assert routed.count() == 20 * len(set(index.folders.tolist())) <= 20 * vector_index.MAX_FOLDERS
    assert routed.groupBy("id").sum("pairs").select("sum(pairs)").distinct().collect() == [(2000,)]


def test_similarities_are_rounded_as_the_sql_rounds(spark):
    values = [0.5047875, 0.1234565, -0.5047875, 0.0000005, 1.0, None]
    rows = spark.createDataFrame([(v,) for v in values], "similarity double").select(texts._six("similarity"))
    want = duckdb.sql("SELECT round(unnest([0.5047875, 0.1234565, -0.5047875, 0.0000005, 1.0, NULL]::DOUBLE[]), 6)").fetchall()
    assert [r[0] for r in rows.collect()] == [w[0] for w in want]
