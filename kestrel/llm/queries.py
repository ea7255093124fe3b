"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe_count, chat_repair, crf_toxicity, license_rules, lsa_decontam, odd_sketch, phrase_graph, sentencepiece_nbest, stream_dedup, subword_langid, suffix_tree_lm, turn_repair, window_packing
from kestrel.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.summary(chat_repair.pieces(table(spark, sf_dir, "conversations")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece_nbest.digests(table(spark, sf_dir, "documents"), f.read())


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.duplicates(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe_count.token_counts(table(spark, sf_dir, "documents"), f.read())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = crf_toxicity.score(docs, crf_toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"),
                         F.get("spans", F.lit(0))["start"].alias("first_start"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subword_langid.identify(docs, subword_langid.train(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(table(spark, sf_dir, "documents")).drop("path_words")


def op12_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    with open(path or tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return window_packing.pack(table(spark, sf_dir, "documents"), f.read())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.summary(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_sentencepiece, op3_minhash_dedup, op4_decontamination, op5_license_scan, op6_exact_dedup, op7_lm_score, op8_token_counts, op9_toxicity, op10_language_id, op11_collocations, op12_packing, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {
    "op5_license_scan": license_rules.oracle_sql(),
    "op6_exact_dedup": stream_dedup.ORACLE_SQL,
    "op11_collocations": phrase_graph.ORACLE_SQL,
}
