"""Batch text embedding.

The default model needs no download and no Python: a deterministic hashed bag of
words in DataFrame functions. A token adds +1 or -1 to one dimension, both taken from
its md5; the sums are L2-normalised. A caller's own model, any ``embed(list[str]) ->
array (n, dim)``, runs in an iterator pandas UDF, built once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import tokens

BATCH_SIZE = 128


def normalise_output(vecs) -> np.ndarray:
    """Model outputs as float32 matrix: a nested single row becomes its first
    row, bytes are read as float32 (I15)."""
    if isinstance(vecs, (bytes, bytearray)):
        return np.frombuffer(vecs, dtype=np.float32)[None, :]
    arr = np.asarray(vecs, dtype=np.float32)
    if arr.ndim == 3:
        arr = arr[:, 0, :]
    if arr.ndim == 1:
        arr = arr[None, :]
    return arr


def model_column(text: Column, model_factory: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """Embeddings by a caller's model."""
    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()                      # once per worker
        for s in batches:
            texts = s.tolist()
            rows = [v for i in range(0, len(texts), BATCH_SIZE) for v in normalise_output(model(texts[i:i + BATCH_SIZE]))]
            yield pd.Series(rows, dtype=object)
    return _embed(text)


def hashed_bow(docs: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """``id, embedding``: token ``w`` counts in dimension ``md5(w)[0:8] mod dim`` with the
    sign of its ninth hex digit (below 8: plus). A text without tokens is the zero vector.
    Everything happens within the row, so nothing is shuffled, and rows that share an id or
    have none stay rows."""
    def signed(w):
        h = F.md5(w)
        d = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
        return d * 2 + F.when(F.substring(h, 9, 1) < "8", 1).otherwise(0)

    # a code is a dimension and a sign; both counts of a dimension are sizes without its code
    codes = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.transform(tokens(text_col), signed), F.array().cast("array<int>")).alias("codes"))
    without = lambda code: F.size(F.array_remove("codes", code))
    sums = codes.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                          lambda d: (without(d * 2) - without(d * 2 + 1)).cast("double")).alias("v"))
    normed = sums.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    part = lambda x: x / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return normed.select("id", F.transform("v", part).cast("array<float>").alias("embedding"))


def embed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = 64,
                    model_factory=None) -> DataFrame:
    """``id, embedding`` for every document: the hashed bag of words, or a caller's model."""
    if model_factory is None:
        return hashed_bow(docs, id_col, text_col, dim)
    return docs.select(F.col(id_col).alias("id"), model_column(F.col(text_col), model_factory).alias("embedding"))
