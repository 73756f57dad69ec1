"""Ids against the tokenizers library, round trips, and rank and select against plain counting."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing, token_store, tokens
from plumbline.llm.queries import QUERIES, TOKENIZER
from plumbline.llm.token_store import WaveletMatrix

SCHEMA = "doc_id long, text string"
ODD = [
    "", " ", "a", " a", "a ", "a  b", "a \n b", "\n a", "a\n", "a\nb c", "don't 's 't x's", " 's", "x  ", " a 　b c", "a  b",
    "\x1c a b\x1d c", "<|endoftext|> x <|endoftext|>", "1 22 333 é ß 漢字 漢 字", "a | b | c", "tab\t b", "z" * 5000 + " y", "a " * 300, "\r\n \r\n x",
    "Ġ Ġa b", "😀 😀x", "a.\nB c,\nd", "a\n\nb", "a \nb", "\nab", "x\n y", "don't,\n's, a²; ½. b's.", "q\n\tr", "w!?\nw!? w!?", "a\r\nb", "é́. b",
    "x \u2028y z", "n\x85m o",
]


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_odd_texts_like_the_library(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    encoder = tokens.Encoder(TOKENIZER)
    for _ in range(3):
        for some in (ODD, ODD[::-1], ODD[5:9]):
            assert [np.frombuffer(r, "<u4").tolist() for r in encoder.encode(some)] == [plain(t) for t in some]


def test_query_against_the_library(spark, sf_dir, plain):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_wavelet_token_store"](spark, sf_dir).collect()}
    start, expected = 0, {}
    for i, t in docs:
        ids = [*plain(t), 2]
        expected[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 7, 1024, 5000])
def test_rank_select_and_access(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.r_[rng.integers(0, 50_257, 40), 0, 50_256], n).astype(np.uint32)
    matrix = WaveletMatrix.unpacked(n, *WaveletMatrix.build(ids, 16).packed())
    assert matrix.decode().tolist() == ids.tolist()
    at = rng.integers(0, n, 50) if n else np.zeros(0, dtype=int)
    assert matrix.access(at).tolist() == ids[at].tolist()
    for symbol in {*ids[:10].tolist(), 3, 50_256}:
        where = np.flatnonzero(ids == symbol)
        assert matrix.count(symbol) == len(where)
        assert [matrix.select(symbol, k) for k in range(0, len(where), 17)] == where[::17].tolist()
        assert all(matrix.rank(symbol, e) == (where < e).sum() for e in (0, n // 3, n))
        with pytest.raises(IndexError):
            matrix.select(symbol, len(where))


def test_shards_nulls_and_repeats(spark, tmp_path, plain, monkeypatch):
    rows = [(3, "b c"), (None, "null id"), (3, "b c"), (1, None), (2, ""), (9, "long word " * 2_000), (10, "last")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("start", F.lit(1))
    token_store.write_shards(docs, f"{tmp_path}/s", TOKENIZER, partitions=3)
    got = sorted(token_store.read_index(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 9, 10]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert [r.n_tokens for r in got] == [len(plain(t)) + 1 for t in ("null id", "", "", "b c", "b c", "long word " * 2_000, "last")]
    found = token_store.occurrences(spark, f"{tmp_path}/s", 2).collect()
    assert sum(r.n for r in found) == len(rows) and all(r.first is not None for r in found)


def test_empty_table(spark):
    assert token_store.encoded(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_added_tokens_like_the_library_at_its_defaults(spark, tmp_path):
    default = Tokenizer.from_file(TOKENIZER)
    some = [
        *ODD, "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\nb c", "x <|endoftext| > y", "\n<|endoftext|> \n's",
        "  <|endoftext|>  two  ", "<|ENDOFTEXT|> a", "a b<|endoftext|>c d" * 50,
    ]
    ids = [default.encode(t, add_special_tokens=False).ids for t in some]
    assert ids[len(ODD)] == [31373, 220, 50256, 995]
    for _ in range(2):
        assert [np.frombuffer(r, "<u4").tolist() for r in tokens.Encoder.of(TOKENIZER).encode(some)] == ids
    docs = spark.createDataFrame(list(enumerate(some)), SCHEMA)
    token_store.write_shards(docs, f"{tmp_path}/s", TOKENIZER, partitions=3)
    got = sorted(token_store.read_index(spark, f"{tmp_path}/s").collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in got] == [len(i) + 1 for i in ids]
    assert [r.start for r in got] == [0, *np.cumsum([len(i) + 1 for i in ids])[:-1]]
    rows = packing.packed(docs, TOKENIZER).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {
        i: zlib.crc32(np.array([*own, 2], dtype="<u4").tobytes()) for i, own in enumerate(ids) if len(own) < 1024
    } | {r.doc_id: r.ids_crc32 for r in rows if len(ids[r.doc_id]) >= 1024}
