"""Vectors for texts, in batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024  # fixed value: the published size of stored embeddings
SPREAD = 0.1  # fixed value: vectors without a model lie in [-0.1, 0.1]

EmbedBatch = Callable[[Sequence[str]], Sequence[Sequence[float]]]


_WORD = re.compile(r"\w+")


def hashed_words(texts: Sequence[str]) -> list[np.ndarray]:
    """Bag-of-words vectors without a model: each word adds one to the place, and in the direction, that its hash names.

    Vectors have length ``SPREAD``, that of a text without words none; equal texts get equal vectors, on every machine.
    """
    out = []
    for text in texts:
        vector = np.zeros(DIMENSIONS, np.float32)
        for word in _WORD.findall(text.lower()):
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            vector[h % DIMENSIONS] += 1 if h >> 31 else -1
        length = np.sqrt((vector.astype(np.float64) ** 2).sum())
        out.append(vector * np.float32(SPREAD / length) if length else vector)
    return out


def _made(embed_batch: EmbedBatch, texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, error) of each text.  A batch that fails is halved until what fails stands alone."""
    try:
        return [(np.asarray(v, dtype=np.float32), None) for _, v in zip(texts, embed_batch(texts), strict=True)]
    except Exception as error:  # a model may raise anything; the rows carry it
        if len(texts) == 1:
            return [(None, str(error))]
    half = len(texts) // 2
    return _made(embed_batch, texts[:half]) + _made(embed_batch, texts[half:])


def embed(
    df: DataFrame, text: str, load: Callable[[], EmbedBatch] = lambda: hashed_words, *,
    output: str = "embedding", batch_rows: int = 128,
) -> DataFrame:
    """Add a vector per row.  ``load`` runs once per task and gives the batch function.

    A text that makes its batch fail, or gets no vector of its own, has a null vector and the message in ``embedding_error``; the
    other texts of the batch are not affected, at twice the logarithm of its size in further calls for each such text.
    Null texts have neither.  Only the text crosses into Python.
    """
    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        embed_batch = load()
        for texts in batches:
            vectors: list[np.ndarray | None] = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            given = [i for i, t in enumerate(texts) if isinstance(t, str)]
            for start in range(0, len(given), batch_rows):
                at = given[start:start + batch_rows]
                for i, (vector, error) in zip(at, _made(embed_batch, [texts.iloc[i] for i in at])):
                    vectors[i], errors[i] = vector, error
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return (
        df.withColumn("_made", run(F.col(text)))
        .select(*df.columns, F.col("_made.vector").alias(output), F.col("_made.error").alias("embedding_error"))
    )


def hashed_features(df: DataFrame, text: str, *, output: str = "embedding", dims: int = DIMENSIONS) -> DataFrame:
    """Unit-length bag-of-words vectors, without Python workers or a model."""
    words = Tokenizer(inputCol=text, outputCol="_words").transform(df.na.fill("", [text]))
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counts)
    return unit.withColumn(output, vector_to_array(F.col("_unit"), "float32")).drop("_words", "_counts", "_unit")


def understanding_texts(understandings: DataFrame) -> DataFrame:
    """The text that is embedded for a stored understanding."""
    return understandings.withColumn(
        "embedding_text", F.concat(F.col("table_id"), F.lit(": "), F.coalesce("business_description", F.lit("")))
    )


def query_texts(table_ids: DataFrame) -> DataFrame:
    """The text that is embedded to look for understandings like a table."""
    return table_ids.withColumn("embedding_text", F.concat(F.lit("data table named "), F.col("table_id")))
