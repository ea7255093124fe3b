"""Hybrid search by reciprocal rank fusion.

Per query: the best ``candidates`` by vector distance with ``rank()`` over
the distance, the best ``candidates`` by cover density with ``rank()`` over
the score; a full outer join on ``(query_id, id)``; the fused score
``coalesce(1/(c+rank_s), 0) + coalesce(1/(c+rank_k), 0)``; the best ``k`` by
``(rrf_score desc, id)``. Both cuts happen per query before any rank, so no
rank ever needs a global window (SURVEY 2.4.2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators import ann as AN
from kestrel.operators import block_index as BI
from kestrel.operators import keyword as KW
from kestrel.operators.filters import apply_filters
from kestrel.operators.knn import knn

CANDIDATES = 20
RRF_CONSTANT = 60
#: Hits of a question at most (a fixed limit of the retrieval interface).
MOST_HITS = 100


def semantic_rank(corpus: DataFrame, queries: DataFrame, candidates: int = CANDIDATES,
                  filters: dict | None = None) -> DataFrame:
    """``query_id, id, distance, rank`` for the vector branch (F1)."""
    top = knn(corpus, queries, k=candidates, metric="l2", filters=filters).drop("rank")
    w = Window.partitionBy("query_id").orderBy("distance")
    return top.withColumn("rank", F.rank().over(w).cast("long"))


def hybrid_search(corpus: DataFrame, questions: DataFrame, k: int = 5,
                  candidates: int = CANDIDATES, rrf_constant: int = RRF_CONSTANT,
                  filters: dict | None = None, index: KW.KeywordIndex | None = None) -> DataFrame:
    """``query_id, rank, id, rrf_score``. ``questions`` has ``query_id, text,
    embedding``; ``index`` is a text index of the corpus, built here if missing.
    ``filters`` apply to both branches; documents without a vector take part in
    the keyword branch."""
    docs = apply_filters(corpus, filters)
    if index is None:
        index = KW.build_index(docs)
    elif filters:
        index = index.within(docs)
    sem = semantic_rank(docs, questions.select("query_id", "embedding"), candidates)
    qterms = KW.query_terms(questions)
    kw = KW.keyword_rank(index, qterms, limit=candidates)
    return fuse(sem, kw, k, rrf_constant)


def fuse(sem: DataFrame, kw: DataFrame, k: int = 5, rrf_constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``query_id, id, rank`` (C1,
    I4, I5, G2): full outer join, summed ``1/(c+rank)``, best ``k`` by
    ``(rrf_score desc, id)``."""
    c = float(rrf_constant)
    fused = (sem.select("query_id", "id", F.col("rank").alias("s_rank"))
             .join(kw.select("query_id", "id", F.col("rank").alias("k_rank")), ["query_id", "id"], "full_outer")
             .select("query_id", "id",
                     (F.coalesce(F.lit(1.0) / (F.lit(c) + F.col("s_rank")), F.lit(0.0))
                      + F.coalesce(F.lit(1.0) / (F.lit(c) + F.col("k_rank")), F.lit(0.0))).alias("rrf_score")))
    w = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("id"))
    return (fused.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= k).select("query_id", "rank", "id", "rrf_score"))


def retrieve(corpus: DataFrame, questions: DataFrame, k: int = 5, use_hybrid: bool = True,
             filters: dict | None = None, index: KW.KeywordIndex | None = None, strategy: str | None = None,
             ann: BI.BlockIndex | None = None, nprobe: int = 10, **lsh) -> DataFrame:
    """Hybrid or plain vector search, filtered in both forms. Returns
    ``query_id, rank, id`` and ``rrf_score`` (higher is better) or ``distance``
    (lower is better).

    ``strategy`` picks the engine of plain search by any name that :func:`ann.strategy_name`
    knows: exact; ivf, through the stored index ``ann`` (exact search if there is none); lsh,
    with the settings of :func:`ann.lsh_search`. The engine that answered is then a column."""
    if not 0 < k <= MOST_HITS:
        raise ValueError(f"k must be from 1 to {MOST_HITS}")
    if use_hybrid:
        return hybrid_search(corpus, questions, k, filters=filters, index=index)
    asked = questions.select("query_id", "embedding")
    engine = AN.strategy_name(strategy) if strategy else "exact"
    if engine == "ivf" and ann is None:
        engine = "exact"
    if engine == "ivf":
        hits = BI.search(ann, asked, k, nprobe, "l2", filters)
    elif engine == "lsh":
        hits = AN.lsh_search(corpus, asked, k, filters=filters, **lsh)
    else:
        hits = knn(corpus, asked, k=k, metric="l2", filters=filters)
    return hits.withColumn("strategy", F.lit(engine)) if strategy else hits
