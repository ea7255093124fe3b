"""Embeddings by content: each distinct text goes to the model once."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from kestrel.functions.embed import embed_documents
from kestrel.session import shared_path
from kestrel.sources import embed_cache as EC

KIND = "doc_id long, text string, key string, embedding string"      # names that the cache uses itself
ROWS = [(1, "one"), (2, "two"), (2, "two"), (None, "one"), (None, None), (3, ""), (4, "x" * 100_000)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "e") for i, t in rows], KIND)


def _counting(folder):
    os.makedirs(folder)

    def factory():
        def model(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(f"{len(t)}:{t[:5]}" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]
        return model
    return factory


def _seen(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n"))


def test_each_text_is_embedded_once_over_two_calls(spark, tmp_path):
    path, folder = shared_path(spark, "embeddings", unique=True), f"{tmp_path}/calls"
    model = _counting(folder)
    embed = lambda rows: [(r["id"], r["embedding"]) for r in EC.embed(_frame(spark, rows), path, "m1", "doc_id", model_factory=model).collect()]
    order = lambda rows: sorted(rows, key=str)
    want = lambda rows: order([(i, [float(len(t or "")), 1.0]) for i, t in rows])
    assert order(embed(ROWS[:4])) == want(ROWS[:4])
    assert _seen(folder) == ["3:one", "3:two"]
    more = [*ROWS, (9, "two"), (10, "three")]
    assert order(embed(more)) == want(more)
    assert _seen(folder) == sorted(["3:one", "3:two", "0:", "100000:xxxxx", "5:three"])
    assert order(embed(more)) == want(more) and len(_seen(folder)) == 5
    assert embed([]) == []


def test_models_do_not_mix(spark):
    path = shared_path(spark, "embeddings", unique=True)
    docs = _frame(spark, ROWS)
    for dim in (8, 16):
        got = EC.embed(docs, path, id_col="doc_id", dim=dim).collect()
        assert len(got) == len(ROWS) and all(len(r["embedding"]) == dim for r in got)
    with pytest.raises(ValueError):
        EC.embed(docs, path, "../m", "doc_id", model_factory=lambda: None)


def test_copies_of_a_third_of_all_rows(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words").otherwise(
        F.concat(F.lit("word"), F.col("id").cast("string"))).alias("text"))
    path = shared_path(spark, "embeddings", unique=True)
    got = EC.embed(docs, path, id_col="doc_id", dim=8)
    assert got.count() == 6000 and got.select("id").distinct().count() == 6000
    assert EC.cached(spark, path, "hashed-8").count() == 4001
    plain = embed_documents(docs, dim=8)
    assert got.exceptAll(plain).count() == 0
