"""Hits to answers: hydrate, result cards, context, prompts, responses and
chunk assembly (C2, B17, F4, I16, K1-K6).

Everything is per question and runs for a whole frame of questions at once;
groups are bounded by ``k`` hits per question.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prompt template, answers without hits, card defaults.
PROMPT_HEAD = ("You are a helpful assistant. Answer the user's question using ONLY the provided "
               "context documents.\nIf the answer is not contained in the context, say \"I don't "
               "have enough information to answer that.\"\n\nContext:\n")
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_TAIL = "\nAnswer:"
NO_HITS_ANSWER = "No documents found matching your query."
NO_HITS_LIBRARY = "No documents found."
DEFAULT_AUTHOR = "arXiv"
DEFAULT_CATEGORY = "cs.AI"


def hydrate(hits: DataFrame, docs: DataFrame, score: str = "distance") -> DataFrame:
    """Join hits to their documents by id (C2): one join instead of one
    lookup per hit; ids without a document are dropped; the hit keeps its
    own score."""
    return (hits.join(docs.select("id", "content", "metadata"), "id", "inner")
            .select("query_id", "rank", "id", score, "content",
                    F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata")))


def _json_text(metadata, field: str):
    return F.get_json_object(metadata, f"$.{field}")


def hit_cards(hydrated: DataFrame, score: str = "distance") -> DataFrame:
    """Display rows (B17): 1-based position, score with 4 decimals, author
    and category from the metadata with defaults (an empty value also gets
    the default), tags joined by commas."""
    meta = F.col("metadata")
    tags = F.from_json(_json_text(meta, "tags"), "array<string>")
    return hydrated.select(
        "query_id", F.col("rank").alias("position"), "id",
        F.format_string("%.4f", F.col(score)).alias("score"),
        F.coalesce(F.nullif(_json_text(meta, "author"), F.lit("")), F.lit(DEFAULT_AUTHOR)).alias("author"),
        F.coalesce(F.nullif(_json_text(meta, "category"), F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.array_join(tags, ","), F.lit("")).alias("tags"))


def contexts(hydrated: DataFrame) -> DataFrame:
    """``query_id, n_hits, context`` (K1): ``Document {id}: {content}`` per
    hit in rank order, separated by a blank line."""
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "content")))
    return hydrated.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.array_join(F.transform(items, lambda h: F.concat(F.lit("Document "), h["id"].cast("string"),
                                                            F.lit(": "), h["content"])), "\n\n").alias("context"))


def prompts(questions: DataFrame, hydrated: DataFrame, no_hits: str = NO_HITS_ANSWER) -> DataFrame:
    """``query_id, n_hits, prompt, answer`` (K2, K3): a question without hits
    gets the fixed answer and no prompt."""
    ctx = contexts(hydrated)
    q = questions.select("query_id", "text")
    joined = q.join(ctx, "query_id", "left")
    has = F.coalesce(F.col("n_hits"), F.lit(0)) > 0
    return joined.select(
        "query_id", F.coalesce(F.col("n_hits"), F.lit(0)).cast("long").alias("n_hits"),
        F.when(has, F.concat(F.lit(PROMPT_HEAD), F.col("context"), F.lit(PROMPT_QUESTION),
                             F.col("text"), F.lit(PROMPT_TAIL))).alias("prompt"),
        F.when(~has, F.lit(no_hits)).alias("answer"))


def answer_with(prompt_rows: DataFrame, generate) -> DataFrame:
    """Optional answer step (K4): ``generate(list[str]) -> list[str]`` runs in
    Arrow batches on the executors; rows that already have an answer keep it."""

    @F.pandas_udf("string")
    def _answer(p: pd.Series) -> pd.Series:
        mask = p.notna()
        out = pd.Series([None] * len(p), dtype=object)
        if mask.any():
            out[mask] = list(generate(p[mask].tolist()))
        return out
    return prompt_rows.withColumn("answer", F.coalesce(F.col("answer"), _answer(F.col("prompt"))))


def responses(questions: DataFrame, hydrated: DataFrame, engine: str, score: str = "distance") -> DataFrame:
    """Response rows (K5): question, engine, answer text when no hits, and the
    documents as an array of ``(id, content, distance, metadata)`` in rank order."""
    docs = (hydrated.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "content", F.col(score).alias("distance"),
                                             "metadata"))).alias("_d"))
        .select("query_id", F.transform("_d", lambda d: d.dropFields("rank")).alias("documents")))
    out = questions.select("query_id", F.col("text").alias("query")).join(docs, "query_id", "left")
    return out.select("query_id", "query", F.lit(engine).alias("retrieval_engine"),
                      F.when(F.col("documents").isNull(), F.lit(NO_HITS_ANSWER)).alias("answer"),
                      F.coalesce(F.col("documents"), F.array().cast(docs.schema["documents"].dataType))
                      .alias("documents"))


def assemble_chunks(lines: DataFrame, request_col: str = "request_id", seq_col: str = "seq",
                    line_col: str = "line") -> DataFrame:
    """NDJSON chunk rows -> one text per request (K6): blank lines skipped, a
    missing ``response`` field counts as ``''``, chunks joined in ``seq`` order."""
    kept = lines.filter(F.length(F.trim(F.col(line_col))) > 0).select(
        F.col(request_col).alias("request_id"), F.col(seq_col).alias("seq"),
        F.coalesce(F.get_json_object(F.col(line_col), "$.response"), F.lit("")).alias("token"))
    return kept.groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda s: s["token"]),
                     "").alias("response"))
