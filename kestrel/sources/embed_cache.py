"""Embeddings kept by content (A6, A7): a text goes to the model once, whatever its id.

The cache is a Parquet folder for each model, ``key, embedding``, the key being the SHA-256
of the text. Keys of the wanted texts are looked up, the texts that are not there are embedded
once each and appended, then every row takes its vector by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.embed import embed_documents
from kestrel.session import materialized

_SCHEMA = "key binary, embedding array<float>"
#: Copies of one text may be a third of all rows: from a share of 1 / HOT, they are spread over SALT
#: places in the last join.
HOT, SALT = 1000, 64


def content_key(text: Column) -> Column:
    """SHA-256 of the text; null counts as empty, as it does for the model."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def cached(spark: SparkSession, path: str, model: str) -> DataFrame:
    """``key, embedding`` of all texts that the model has seen."""
    try:
        return spark.read.schema(_SCHEMA).parquet(_folder(path, model))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def _folder(path: str, model: str) -> str:
    if not model or any(c in model for c in "/\\:*?[]{}%#"):
        raise ValueError(f"not a folder name: {model!r}")
    return f"{path.rstrip('/')}/{model}"


def fill(docs: DataFrame, path: str, model: str, text_col: str = "text", dim: int = 64,
         model_factory: Callable | None = None) -> None:
    """Embeds the distinct texts of ``docs`` that the cache lacks and appends them. Copies meet before
    the look-up (and already in the tasks that read them), so that the exchange by key serves both. The
    rows appear when the job commits; a call that was interrupted is repeated. One writer at a time."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    texts = docs.select(content_key(F.col(text_col).cast("string")).alias("key"), text).dropDuplicates(["key"])
    new = texts.join(cached(spark, path, model).select("key"), "key", "left_anti")
    rows = embed_documents(new, "key", "text", dim, model_factory).withColumnRenamed("id", "key")
    rows.write.mode("append").parquet(_folder(path, model))


def embed(docs: DataFrame, path: str, model: str = "hashed", id_col: str = "id", text_col: str = "text", dim: int = 64,
          model_factory: Callable | None = None) -> DataFrame:
    """``id, embedding`` of every row of ``docs`` through the cache at ``path``.

    ``model`` names what decides the vectors (the model and its settings): vectors of different names
    never mix; the default model's name gets its dimension. Null texts count as empty; rows that share
    an id or have none stay rows; an empty frame gives an empty result; other columns are not read."""
    name = f"{model}-{dim}" if model_factory is None else model
    fill(docs, path, name, text_col, dim, model_factory)
    rows = materialized(docs.select(F.col(id_col).alias("id"), content_key(F.col(text_col).cast("string")).alias("key"),
                                    (F.monotonically_increasing_id() % SALT).cast("int").alias("salt")))
    # a text of more than 1 / HOT of all rows is spread, and only its vector repeated: fewer than HOT keys
    hot = F.broadcast(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                      .filter(F.col("n") * HOT > rows.count()).select("key", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    rows = rows.join(hot, "key", "left").select("id", "key", F.when(F.col("hot"), F.col("salt")).otherwise(0).alias("salt"))
    vectors = cached(docs.sparkSession, path, name).join(hot, "key", "left").select("key", "embedding", F.explode(salts).alias("salt"))
    return rows.join(vectors, ["key", "salt"]).select("id", "embedding")
