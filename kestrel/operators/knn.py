"""Exact k-nearest-neighbour search.

Two physical forms, same rows:

``knn_single``  one query vector as an array literal: a projection over the
                corpus and TakeOrderedAndProject. No join, no shuffle.
``knn``         a query set, in blocks: blocks of corpus vectors are joined with
                blocks of query vectors, each pair is scored in NumPy, and only
                the top-k per query of all pairs of a cell leaves the task. The merge is a
                ``row_number() <= k`` window per query, which Spark plans as
                WindowGroupLimit (partial before the shuffle, final after), so
                no query-corpus pair is ever materialised.

Ties are always broken by ``id`` (contract S10). Filters are applied before
the top-k (contract S8).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.vectors import (arrow_matrix, block_scores, check_metric, distance,
                                       order_ascending, pair_scores)
from kestrel.operators.filters import apply_filters

# Vectors of a corpus block and of a query block.
CORPUS_BLOCK, QUERY_BLOCK = 4096, 512
# Query tile inside a task: bounds the (batch x tile) score matrix.
QUERY_TILE = 512
#: Cells that blocks of vectors are dealt to at most, each with a copy of the query blocks: bounds the copies
#: also where shuffle partitions are raised with the input.
MOST_CELLS = 128


def score_name(metric: str) -> str:
    return "score" if metric == "ip" else "distance"


def _order_cols(metric: str, col: str):
    return [F.col(col).asc() if order_ascending(metric) else F.col(col).desc(), F.col("id").asc()]


def rank_per_query(df: DataFrame, k: int, metric: str, col: str | None = None,
                   key: str = "query_id") -> DataFrame:
    """Keep the best ``k`` rows per query with a 1-based ``rank`` (BIGINT)."""
    col = col or score_name(metric)
    w = Window.partitionBy(key).orderBy(*_order_cols(metric, col))
    return (df.withColumn("rank", F.row_number().over(w))
              .filter(F.col("rank") <= k)
              .withColumn("rank", F.col("rank").cast("long")))


# ---------------------------------------------------------------------------
# single query
# ---------------------------------------------------------------------------

def knn_single(corpus: DataFrame, vector, k: int = 5, metric: str = "l2",
               filters: dict | None = None, mode: str = "null") -> DataFrame:
    """Top-k for one vector: ``rank, id, distance`` (``score`` for ip)."""
    check_metric(metric)
    if k <= 0:
        raise ValueError("k must be positive")
    name = score_name(metric)
    scored = (apply_filters(corpus, filters, mode)
              .filter(F.col("embedding").isNotNull())
              .select("id", distance(metric, "embedding", list(vector)).alias(name)))
    top = scored.orderBy(*_order_cols(metric, name)).limit(k)
    # the window runs over at most k rows
    w = Window.orderBy(*_order_cols(metric, name))
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "id", name)


# ---------------------------------------------------------------------------
# batch, blocks of vectors
# ---------------------------------------------------------------------------

def _local_topk(qids: np.ndarray, qmat: np.ndarray, ids: np.ndarray, x: np.ndarray,
                k: int, metric: str):
    """Local top-k per query of one pair of blocks; returns (query_id, id, score)."""
    out_q, out_id, out_s = [], [], []
    sign = -1.0 if metric == "ip" else 1.0
    for start in range(0, len(qids), QUERY_TILE):
        sl = slice(start, min(start + QUERY_TILE, len(qids)))
        qt = qmat[sl]
        approx = sign * block_scores(x, qt, metric)            # (b, t), smaller = better
        kk = min(k, approx.shape[0])
        thr = np.partition(approx, kk - 1, axis=0)[kk - 1]    # k-th best per query
        tol = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(thr), thr, 0.0)))
        cand = (approx <= (thr + tol)[None, :]) & np.isfinite(approx)
        rows, cols = np.nonzero(cand)
        if rows.size == 0:
            continue
        exact = pair_scores(x[rows], qt[cols], metric)
        key = sign * exact
        order = np.lexsort((ids[rows], key, cols))
        rows, cols, exact = rows[order], cols[order], exact[order]
        # position within each query's group; keep the first k
        first = np.r_[0, np.flatnonzero(np.diff(cols)) + 1]
        group_start = np.repeat(first, np.diff(np.r_[first, cols.size]))
        keep = (np.arange(cols.size) - group_start) < k
        out_q.append(qids[sl][cols[keep]])
        out_id.append(ids[rows[keep]])
        out_s.append(exact[keep])
    if not out_q:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float64),)
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def merged(parts: list[tuple], k: int, metric: str):
    """Best ``k`` rows per query of several ``(query_id, id, score)``."""
    qids, ids, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -score if metric == "ip" else score, qids))
    first = np.flatnonzero(np.diff(qids[order], prepend=qids[order][:1] - 1))
    keep = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < k]
    return qids[keep], ids[keep], score[keep]


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors in the width in which they are stored."""
    x = arrow_matrix(col, len(col[0]))
    return x.astype(np.float32) if pa.types.is_float32(col.type.value_type) else x


def _unpacked(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(matrix) == 4 * dim * len(ids) else np.float64
    return ids, np.frombuffer(matrix, kind).reshape(-1, dim).astype(float)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """``vectors`` (``id, part, embedding``) as blocks: ``part, ids, matrix, dim``,
    each of at most ``rows`` vectors of one part. Rows without a vector are left out;
    vectors of different sizes in one block raise."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _matrix(b.column(2))
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            out = [g[i:i + rows] for g in np.split(order, edges) for i in range(0, len(g), rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part[g[0]] for g in out], pa.int64()), pa.array([ids[g].tobytes() for g in out], pa.binary()),
                 pa.array([x[g].tobytes() for g in out], pa.binary()), pa.array([x.shape[1]] * len(out), pa.int32())],
                ["part", "ids", "matrix", "dim"])

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("part").cast("long").alias("part"), "embedding") \
        .filter(F.col("embedding").isNotNull()).mapInArrow(run, "part long, ids binary, matrix binary, dim int")


def block_topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str, salts: int) -> DataFrame:
    """Best ``k`` per query among the corpus rows of the query's parts: ``query_id,
    rank, id, distance`` (``score`` for ip).

    ``corpus``: ``id, part, embedding``; ``queries`` the same, a query once for each
    part it searches. Both sides are packed into blocks that are joined on the part; a
    part's corpus blocks are spread over ``salts`` cells and its query blocks copied to
    each, so a part holding any share of the corpus is many tasks. A task multiplies
    pairs of blocks; a query block comes with one corpus block of a cell after the other,
    and at most ``k`` rows per query are kept and passed on, however many blocks these
    are. The merge is a limited window, again with at most ``k`` rows per query and task.
    Nothing passes through the driver and no job runs while this plan is built."""
    check_metric(metric)
    name = score_name(metric)
    left = packed(corpus, CORPUS_BLOCK).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    right = packed(queries, QUERY_BLOCK).select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("ids").alias("qids"),
        F.col("matrix").alias("qmatrix"), F.col("dim").alias("qdim"))
    # merged with the queries as the side that is read once, a query block meets its corpus blocks in a row
    pairs = right.hint("merge").join(left, ["part", "salt"]).select("ids", "matrix", "dim", "qids", "qmatrix", "qdim")

    def rows(best):
        return pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.int64()),
                                           pa.array(best[2], pa.float64())], ["query_id", "id", name])

    def run(batches):
        own, best = None, None
        for b in batches:
            for i in range(b.num_rows):
                ids, x, dim, qids, q, qdim = (c[i].as_py() for c in b.columns)
                if dim != qdim:
                    raise ValueError(f"query vectors of size {qdim} for stored vectors of size {dim}")
                got = _local_topk(*_unpacked(qids, q, dim), *_unpacked(ids, x, dim), k, metric)
                if best is not None and qids != own:
                    yield rows(best)
                    best = None
                own, best = qids, got if best is None else merged([best, got], k, metric)
        if best is not None:
            yield rows(best)

    local = pairs.mapInArrow(run, f"query_id long, id long, {name} double")
    return rank_per_query(local, k, metric, name).select("query_id", "rank", "id", name)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2",
        filters: dict | None = None, mode: str = "null", query_id: str = "query_id",
        salts: int | None = None) -> DataFrame:
    """Exact top-k per query: ``query_id, rank, id, distance`` (``score`` for ip).
    All of the corpus is one part, spread over ``salts`` cells (by default as many as
    the session's shuffle partitions, ``MOST_CELLS`` at most)."""
    check_metric(metric)
    if k <= 0:
        raise ValueError("k must be positive")
    salts = salts or min(MOST_CELLS, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = F.lit(0).alias("part")
    return block_topk(apply_filters(corpus, filters, mode).select("id", one, "embedding"),
                      queries.select(F.col(query_id).alias("id"), one, "embedding"), k, metric, salts)


# ---------------------------------------------------------------------------
# lookups by id
# ---------------------------------------------------------------------------

def unknown_ids(corpus: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Requested ids that the corpus does not hold (anti join)."""
    req = ids.select(F.col(id_col).cast("long").alias("id")).distinct()
    return req.join(corpus.select("id"), "id", "left_anti")


def vectors_for_ids(corpus: DataFrame, ids: DataFrame, id_col: str = "id",
                    strict: bool = True) -> DataFrame:
    """Stored vectors of the requested ids as a query frame (C5). In strict
    mode an id that is not stored raises, as the index lookup does."""
    req = ids.select(F.col(id_col).cast("long").alias("query_id")).distinct()
    if strict:
        missing = unknown_ids(corpus, req, "query_id").limit(5).collect()
        if missing:
            raise KeyError(f"ids not in the index: {[r['id'] for r in missing]}")
    return req.join(corpus.filter(F.col("embedding").isNotNull()).select(F.col("id").alias("query_id"), "embedding"), "query_id", "inner")


def search_by_id(corpus: DataFrame, ids: DataFrame, k: int = 5, metric: str = "l2_squared",
                 id_col: str = "id", strict: bool = True) -> DataFrame:
    """Neighbours of stored vectors (D5): the vector itself is a hit at 0."""
    return knn(corpus, vectors_for_ids(corpus, ids, id_col, strict), k=k, metric=metric)


def lookup_by_id(corpus: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Point lookups as one join (B9): ``id, content, distance=0.0, metadata``;
    absent ids give no row, documents without a vector are found too."""
    req = ids.select(F.col(id_col).cast("long").alias("id")).distinct()
    return (req.join(corpus, "id", "inner")
            .select("id", "content", F.lit(0.0).alias("distance"),
                    F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata")))

