"""Exact deduplication with keyed streaming state.

A stream of fingerprints updates one state entry for each digest, kept on disk
(RocksDB) and never expired: the smallest identifier seen, the locator of that
row's content, and the number of rows. Equal digests are only a hit: the bytes at
both locators are fetched and compared in full, and a digest whose texts differ is
grouped anew by the texts themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrel.llm.common import scratch, settings, written

#: Rows of one digest that are compared with one copy of the kept text; larger groups get more copies.
COPIES_PER_TASK = 2_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # many small stores: no disk space is set aside for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` and two columns that locate a row's content: the file and the row's
    number in it. Rows that aren't read straight from Parquet are written first."""
    for frame in (docs, None):
        frame = frame or written(docs, "located")
        try:
            meta = frame.metadataColumn("_metadata")
            frame.select(meta["row_index"]).schema
            return frame, meta["file_path"], meta["row_index"]
        except AnalysisException:
            continue
    raise ValueError("rows without a place")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """``doc_id, digest, file, row``: small rows that the stream takes in."""
    frame, file, row = located(docs)
    return frame.select(F.col(doc_id).cast("long").alias("doc_id"), digest(normalised(F.col(text))).alias("digest"),
                        file.alias("file"), row.alias("row"))


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the keyed state over a stream of fingerprints, until it is used up.

    Each micro-batch writes the entries that it changed to ``out/batch=N`` (anew if
    the batch is repeated). Starting again with the same ``checkpoint`` goes on
    with the state as it was, so later arrivals meet all earlier digests. Rows are
    combined before the shuffle, so a digest of very many rows is no hot key."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    state = stream.groupBy("digest").agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(stream.sparkSession, _STATE):
        return (state.writeStream.outputMode("update").foreachBatch(save)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def entries(spark: SparkSession, out: str) -> DataFrame:
    """``digest, keep, n`` after all micro-batches written to ``out``."""
    return (spark.read.parquet(out).groupBy("digest")
            .agg(F.max_by(F.struct("keep", "n"), F.col("batch")).alias("e")).select("digest", "e.keep", "e.n"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256) -> tuple[DataFrame, DataFrame]:
    """The located rows of ``docs`` and, for each, ``doc_id, file, row, digest,
    keep_id, keep_file, keep_row, group_size``.

    The kept row of equal texts has the smallest id; null ids come last, and of
    repeated rows the first in file and row order stays."""
    spark = docs.sparkSession
    frame, file, row = located(docs)
    source = scratch(spark, "fingerprints")
    prints = fingerprints(frame, doc_id, text, digest)
    prints.write.parquet(source)
    out = scratch(spark, "state")
    # a first, empty entry table gives an empty input its schema
    stream = spark.readStream.schema(prints.schema).parquet(source)
    start(stream, out, scratch(spark, "stream")).awaitTermination()
    prints = spark.read.schema(prints.schema).parquet(source)
    if prints.isEmpty():
        return frame, prints.select("doc_id", "file", "row", "digest", F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"),
                                    F.col("row").alias("keep_row"), F.lit(0).cast("long").alias("group_size"))
    state = written(entries(spark, out), "entries")
    grouped = prints.join(state, "digest")

    # full bytes of all hits, fetched by their locators
    hits = grouped.filter("n > 1").select("digest", "file", "row", "keep", "n")
    texts = frame.select(file.alias("file"), row.alias("row"), normalised(F.col(text)).alias("bytes"))
    fetched = written(texts.join(hits, ["file", "row"]), "hits")
    is_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    copies = F.ceil(F.col("n") / COPIES_PER_TASK).cast("int")
    kept = fetched.filter(is_kept).select("digest", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"),
                                          F.col("bytes").alias("kept_bytes"))
    members = fetched.filter(~is_kept).withColumn("copy", F.pmod(F.xxhash64("file", "row"), copies).cast("int"))
    collided = (members.join(kept, ["digest", "copy"]).filter(F.col("bytes") != F.col("kept_bytes"))
                .select("digest").distinct())
    again = fetched.join(written(collided, "collided"), "digest", "left_semi")
    regrouped = again.join(
        again.join(prints.select("file", "row", "doc_id"), ["file", "row"]).groupBy("digest", "bytes").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")).alias("keep2"),
            F.count(F.lit(1)).alias("n2")), ["digest", "bytes"]).select("file", "row", "keep2", "n2")
    regrouped = written(regrouped, "regrouped")

    one = grouped if regrouped.isEmpty() else (
        grouped.join(regrouped, ["file", "row"], "left")
        .withColumns({"keep": F.coalesce("keep2", "keep"), "n": F.coalesce("n2", "n")}))
    return frame, one.select("doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"),
                             F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"),
                             F.col("n").alias("group_size"))


_KEPT = "file = keep_file AND row = keep_row"


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when identical after :func:`normalised`; a null text counts as
    empty, so empty texts form one group. Exactly one row of a group is kept. With
    null ids only, ``keep_id`` is null. An empty table gives an empty result; other
    columns are not read."""
    _, found = classes(docs, doc_id, text, digest)
    return found.select("doc_id", "keep_id", "group_size", F.expr(_KEPT).alias("kept"), F.col("digest").alias("text_sha256"))


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    frame, found = classes(docs, doc_id, text, digest)
    _, file, row = located(frame)
    dropped = found.filter(f"NOT ({_KEPT})").select(F.col("file").alias("__dropped_file"), F.col("row").alias("__dropped_row"))
    at = frame.withColumns({"__file": file, "__row": row})
    return at.join(dropped, (F.col("__file") == F.col("__dropped_file")) & (F.col("__row") == F.col("__dropped_row")),
                   "left_anti").drop("__file", "__row")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t"""
