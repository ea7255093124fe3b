"""Counts, categories, corpus statistics and query sampling (E1-E3, H3,
B14, B16, G5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_documents"))


def distinct_categories(table: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct, non-NULL, non-empty categories in order (contract S9: over all
    rows), all of them unless a ``limit`` is asked for."""
    found = (table.select("category")
             .filter(F.col("category").isNotNull() & (F.col("category") != ""))
             .distinct().orderBy("category"))
    return found if limit is None else found.limit(limit)


def corpus_stats(table: DataFrame, index_flags: dict[str, bool] | None = None,
                 limit: int | None = None) -> DataFrame:
    """One row: document and vector counts, the number of categories, the
    categories joined by commas (the first ``limit`` if asked for), index flags."""
    cat = F.nullif(F.col("category"), F.lit(""))
    # the category list is a scalar subquery: no join of one-row frames
    first = (distinct_categories(table, limit)
             .agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories")))
    out = table.agg(F.count(F.lit(1)).alias("n_documents"), F.count("embedding").alias("n_vectors"),
                    F.countDistinct(cat).alias("n_categories")) \
        .withColumn("categories", first.scalar())
    for name, flag in (index_flags or {}).items():
        out = out.withColumn(name, F.lit(bool(flag)))
    return out


def sample_queries(table: DataFrame, n: int = 50, seed: int = 42, id_col: str = "id") -> DataFrame:
    """``n`` rows without replacement, deterministic for a seed: order by
    ``md5(id:seed)`` then id (G5); TakeOrderedAndProject, no global sort."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return table.orderBy(key, F.col(id_col)).limit(n)


def valid_queries(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop blank questions."""
    return questions.filter(F.length(F.trim(F.col(text_col))) > 0)
