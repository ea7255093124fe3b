"""Corpus cleaning in stages: language, exact copies, near copies, benchmark leaks, encoding.

Each stage's rows are written as Parquet to the shared folder and read again as the next
one's documents. All but the last return the columns of ``documents`` and only drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import lsa_decontam, odd_sketch, sentencepiece_nbest, stream_dedup, subword_langid
from kestrel.llm.common import table, written
from kestrel.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return subword_langid.accepted(docs, subword_langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space apart) stays."""
    return stream_dedup.unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays (five words, 0.8)."""
    return odd_sketch.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return lsa_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentations of each document, and whether decoding gives its text back."""
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        encoded = sentencepiece_nbest.encode(docs, f.read())
    return encoded.select("doc_id", "pieces", "n_pieces", "score", "others", "round_trip")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("encoding", encoding)]

#: SQL cannot express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
