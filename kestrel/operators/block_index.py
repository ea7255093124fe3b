"""A stored IVF index of packed blocks: pruned, filtered and exact search.

Layout. A vector belongs to its nearest centroid's cluster and, by its distance to that
centroid, to one of the cluster's rings. A block is up to ``BLOCK`` vectors of one ring:
their ids and matrix as bytes, the ring's bounds, and the filter columns of each vector
in the same order. Blocks are partitioned by cluster, so a search of few clusters reads
few folders; the bytes go to NumPy as they are stored. Filter columns are a column of
their own, which an unfiltered search doesn't read.

Search. Centroids and the sizes of rings (clusters x rings numbers) are all that the
driver sees. They tell which rings a query opens; the distinct clusters of all queries
prune the scan (dynamic partition pruning) before blocks are joined with query blocks.

``search``        the nearest ``nprobe`` clusters that hold rows surviving the filters, and
                  more until as many rows survive as ``nprobe`` clusters hold without filters
                  (at least ``k``): a filter costs no recall, and no more comparisons.
``search_exact``  opens rings in two steps. The nearest rings with ``k`` rows give each query
                  a k-th distance; by the triangle inequality a ring whose bound is farther
                  cannot hold a better row, and all others are opened. Equals exact search.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.vectors import arrow_matrix, check_metric
from kestrel.operators import ann as AN
from kestrel.operators.filters import predicate
from kestrel.operators.knn import QUERY_BLOCK, _local_topk, _unpacked, packed, rank_per_query, score_name
from kestrel.session import materialized, shared_path

#: Vectors of a block at most, and rings of a cluster at most (of equal width, up to the largest
#: distance; fewer where a ring would hold less than a quarter of a block on average).
BLOCK, RINGS = 1024, 8
#: Digits of distances to centroids, and what bounds are widened by to cover the rounding.
DIGITS, SLACK = 6, 2e-6
#: Cells of the (queries x rings) arrays of a step, and rows handed on at once: what a task holds of either.
OPEN_CELLS, OPEN_ROWS = 1 << 18, 1 << 13
#: Columns that filters may use, kept with each vector if the corpus has them.
ATTRIBUTES = ("author", "date", "category", "tags", "source", "metadata")


@dataclass
class BlockIndex:
    blocks: DataFrame
    centroids: np.ndarray
    width: float
    path: str
    rows: int
    rings: int

    @property
    def nlist(self) -> int:
        return len(self.centroids)


def _placed(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, r, id, embedding, attributes``: each vector's cluster and distance to the centroid."""
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)        # nlist x dim
    kept = [c for c in ATTRIBUTES if c in corpus.columns]
    src = corpus.filter(F.col("embedding").isNotNull()).select(
        F.col("id").cast("long").alias("id"), "embedding", F.struct(*kept, F.lit(1).alias("one")).alias("attributes"))

    def run(batches):
        cents = shared.value
        for b in batches:
            if b.num_rows:
                x = arrow_matrix(b.column(1), cents.shape[1])
                near = AN._nearest(x, cents, 1)[:, 0]
                r = np.round(np.sqrt(np.square(x - cents[near]).sum(axis=1)), DIGITS)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(r), *b.columns], ["cluster", "r", "id", "embedding", "attributes"])

    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, f"cluster int, r double, id long, embedding {types['embedding']}, attributes {types['attributes']}")


def build(corpus: DataFrame, nlist: int = 100, path: str | None = None, train: DataFrame | None = None) -> BlockIndex:
    """Train centroids (:func:`ann.ivf_build`), assign all vectors and write the index. The corpus
    has ``id, embedding`` and any of ``ATTRIBUTES``; rows without a vector are left out."""
    spark = corpus.sparkSession
    path = path or shared_path(spark, "indexes/blocks", unique=True)
    learned = AN.ivf_build(corpus, nlist, train=train).centroids
    centroids = np.array([learned[c] for c in sorted(learned)])
    rows = materialized(_placed(corpus, centroids))
    widest, n = rows.agg(F.max("r"), F.count(F.lit(1))).first()
    n_rings = max(1, min(RINGS, 4 * n // (BLOCK * len(centroids))))
    width = round((widest or 0.0) / n_rings, DIGITS) or 1.0
    ringed = rows.withColumn("ring", F.least(F.floor(F.col("r") / width), F.lit(n_rings - 1)).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in ringed.schema}

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cluster, ring, r = (b.column(k).to_numpy() for k in (0, 1, 2))
            ids, x = b.column(3).to_numpy(), arrow_matrix(b.column(4), centroids.shape[1]).astype(np.float32 if "float" in kinds["embedding"] else np.float64)
            key = cluster.astype(np.int64) * n_rings + ring
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            cuts = [i for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]) for i in range(s, e, BLOCK)]
            ends = [*cuts[1:], len(key)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster[cuts]), pa.array(ring[cuts]), pa.array([e - s for s, e in zip(cuts, ends)], pa.int64()),
                 pa.array([r[s:e].min() for s, e in zip(cuts, ends)]), pa.array([r[s:e].max() for s, e in zip(cuts, ends)]),
                 pa.array([x.shape[1]] * len(cuts), pa.int32()), pa.array([ids[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary()),
                 pa.array([x[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([*cuts, len(key)], pa.int32()), b.column(5))],
                ["cluster", "ring", "n", "r_min", "r_max", "dim", "ids", "matrix", "attributes"])

    # a cluster's rows come from several tasks, so one that holds any share of the corpus is no hot key
    dealt = ringed.select("cluster", "ring", "r", "id", "embedding", "attributes").repartition(
        "cluster", F.pmod(F.xxhash64("id"), F.lit(AN.SALTS))).sortWithinPartitions("cluster", "ring", "id")
    (dealt.mapInArrow(pack, "cluster int, ring int, n long, r_min double, r_max double, dim int, ids binary, matrix binary, "
                            f"attributes array<{kinds['attributes']}>")
     .write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/blocks"))
    config = {"nlist": nlist, "width": width, "kind": "blocks", "rings": n_rings, "rows": n}
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(centroids)], "cluster int, centroid array<double>").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> BlockIndex:
    """Open an index written by :func:`build`."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()              # nlist rows
    return BlockIndex(spark.read.parquet(f"{path}/blocks"), np.array([r["centroid"] for r in rows]), config["width"], path, config["rows"], config["rings"])


def _surviving(index: BlockIndex, filters: dict | None, mode: str) -> DataFrame:
    """Blocks with ``keep``, which of their rows pass the filters (null: all); blocks without any go."""
    if predicate(filters, mode) is None:
        return index.blocks.withColumns({"keep": F.lit(None).cast("array<boolean>"), "left": F.col("n")}).drop("attributes")
    held = {f.name for f in index.blocks.schema["attributes"].dataType.elementType.fields}
    missing = [c for c in ("author", "date", "category", "tags", "source") if any(c == k.split("_")[0] for k in filters)
               and c not in held and not (c == "tags" and mode == "text" and "metadata" in held)]
    if missing:
        raise ValueError(f"the index holds no {missing}")
    passes = F.transform("attributes", lambda a: F.coalesce(predicate(filters, mode, lambda c: a[c]), F.lit(False)))
    return index.blocks.withColumn("keep", passes).drop("attributes").withColumn(
        "left", F.size(F.filter("keep", lambda x: x)).cast("long")).filter("left > 0")


@dataclass
class _Rings:
    """Rings that hold surviving rows: cluster, ring, rows, bounds of their distances to the centroid."""
    cluster: np.ndarray
    ring: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _rings(blocks: DataFrame) -> _Rings:
    rows = blocks.groupBy("cluster", "ring").agg(F.sum("left").alias("n"), F.min("r_min").alias("low"), F.max("r_max").alias("high")) \
        .orderBy("cluster", "ring").collect()                              # at most nlist x RINGS rows
    get = lambda c, kind: np.array([r[c] for r in rows], kind)
    return _Rings(get("cluster", np.int64), get("ring", np.int64), get("n", np.int64), get("low", float), get("high", float))


def _distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2.0 * (q @ centroids.T), 0.0))


def nearest_rings(q: np.ndarray, centroids: np.ndarray, rings: _Rings, need: float, nprobe: int) -> np.ndarray:
    """(queries, rings) which rings each query opens: all of the nearest ``nprobe`` clusters that hold
    rows, and of further ones until ``need`` rows are there."""
    rows = np.bincount(rings.cluster, weights=rings.n, minlength=len(centroids))
    order = np.argsort(np.where(rows > 0, _distances(q, centroids), np.inf), axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    opened = (np.arange(len(centroids)) < nprobe) | (before < need)
    chosen = np.zeros(order.shape, bool)
    np.put_along_axis(chosen, order, opened, axis=1)
    return chosen[:, rings.cluster]


def first_rings(q: np.ndarray, centroids: np.ndarray, rings: _Rings, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least possible distance to each ring, and the rings with the least such that hold ``k`` rows."""
    d = _distances(q, centroids)[:, rings.cluster]
    bound = np.maximum(np.maximum(d - rings.high, rings.low - d) - SLACK, 0.0)
    order = np.lexsort((np.broadcast_to(rings.ring, d.shape), np.broadcast_to(rings.cluster, d.shape), d, bound), axis=1)
    rows = rings.n[order]
    chosen = np.zeros(d.shape, bool)
    np.put_along_axis(chosen, order, np.cumsum(rows, axis=1) - rows < k, axis=1)
    return bound, chosen


def _clusters(rings: _Rings) -> _Rings:
    """The clusters as rings, one each: for searches that open whole clusters."""
    names, at = np.unique(rings.cluster, return_inverse=True)
    return _Rings(names, np.zeros(len(names), np.int64), np.bincount(at, weights=rings.n, minlength=len(names)).astype(np.int64),
                  np.zeros(len(names)), np.zeros(len(names)))


def _opened(index: BlockIndex, queries: DataFrame, rings: _Rings, choose, limit: bool = False) -> DataFrame:
    """``id, part, embedding, cluster, nth``: a query once for each ring that ``choose`` opens."""
    n_rings = index.rings
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, rings))
    tile = max(1, OPEN_CELLS // max(1, len(rings.n)))

    def run(batches):
        centroids, own = shared.value
        for b in batches:
            for i in range(0, b.num_rows, tile):
                some = b.slice(i, tile)
                most = some.column(2).to_numpy(zero_copy_only=False) if limit else None
                row, col = np.nonzero(choose(arrow_matrix(some.column(1), centroids.shape[1]), centroids, own, most))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                for j in range(0, len(row), OPEN_ROWS):                    # a row carries its query's vector
                    at, to, n = pa.array(row[j:j + OPEN_ROWS]), col[j:j + OPEN_ROWS], nth[j:j + OPEN_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(at), pa.array(own.cluster[to] * n_rings + own.ring[to]), some.column(1).take(at),
                         pa.array(own.cluster[to].astype(np.int32)), pa.array(n)], ["id", "part", "embedding", "cluster", "nth"])

    kind = queries.schema["embedding"].dataType.simpleString()
    return queries.mapInArrow(run, f"id long, part long, embedding {kind}, cluster int, nth long")


def _topk(index: BlockIndex, blocks: DataFrame, opened: DataFrame, k: int, metric: str, most: int, whole: bool = False) -> DataFrame:
    """``query_id, id, distance`` of each pair of a block and a query block that opens its ring (with
    ``whole``, its cluster). A query opens ``most`` parts at most."""
    name = score_name(metric)
    # the clusters of all queries, as many as the index has at most: a broadcast of known size, by
    # which the scan of the partitioned blocks is pruned
    probed = F.broadcast(opened.filter(F.col("nth") < most).select("cluster").distinct())
    left = blocks.join(probed, "cluster", "left_semi").select(
        (F.col("cluster").cast("long") * index.rings + (F.lit(0) if whole else F.col("ring"))).alias("part"), F.pmod(F.xxhash64("ids"), F.lit(AN.SALTS)).cast("int").alias("salt"),
        "ids", "matrix", "dim", "keep")
    right = packed(opened.select("id", "part", "embedding"), QUERY_BLOCK).select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(AN.SALTS - 1))).alias("salt"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"),
        F.col("dim").alias("qdim"))
    pairs = left.join(right, ["part", "salt"]).select("ids", "matrix", "dim", "keep", "qids", "qmatrix", "qdim")

    def run(batches):
        for b in batches:
            for ids, x, dim, keep, qids, q, qdim in ([c[i].as_py() for c in b.columns] for i in range(b.num_rows)):   # one pair at a time
                if dim != qdim:
                    raise ValueError(f"query vectors of size {qdim} for stored vectors of size {dim}")
                own, vectors = _unpacked(ids, x, dim)
                if keep is not None:
                    own, vectors = own[keep], vectors[np.array(keep)]
                got = _local_topk(*_unpacked(qids, q, dim), own, vectors, k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())],
                                                 ["query_id", "id", name])

    return pairs.mapInArrow(run, f"query_id long, id long, {name} double")


def _queries(queries: DataFrame, query_id: str) -> DataFrame:
    return queries.select(F.col(query_id).cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())


def _checked(k: int, metric: str) -> None:
    check_metric(metric)
    if k <= 0:
        raise ValueError("k must be positive")


def _probed(index: BlockIndex, queries: DataFrame, k: int, nprobe: int, filters: dict | None, mode: str, query_id: str):
    blocks = _surviving(index, filters, mode)
    rings = _clusters(_rings(blocks))
    need = max(k, nprobe * index.rows / index.nlist) if predicate(filters, mode) is not None else k
    opened = _opened(index, _queries(queries, query_id), rings, lambda q, centroids, own, _: nearest_rings(q, centroids, own, need, nprobe))
    return blocks, rings, materialized(opened)


def search(index: BlockIndex, queries: DataFrame, k: int = 5, nprobe: int = 10, metric: str = "l2", filters: dict | None = None,
           mode: str = "null", query_id: str = "query_id") -> DataFrame:
    """Top-k per query in its nearest ``nprobe`` clusters that hold surviving rows, and with filters in
    further ones (see above): ``query_id, rank, id, distance``. ``nprobe >= nlist`` is exact."""
    _checked(k, metric)
    blocks, rings, opened = _probed(index, queries, k, nprobe, filters, mode, query_id)
    return rank_per_query(_topk(index, blocks, opened, k, metric, len(rings.n), whole=True), k, metric).select("query_id", "rank", "id", score_name(metric))


def share(index: BlockIndex, queries: DataFrame, k: int = 5, nprobe: int = 10, filters: dict | None = None, mode: str = "null",
          query_id: str = "query_id") -> float:
    """The part of all (query, surviving row) pairs that :func:`search` compares."""
    _, rings, opened = _probed(index, queries, k, nprobe, filters, mode, query_id)
    pairs = _queries(queries, query_id).count() * int(rings.n.sum())
    compared = opened.select("part").groupBy("part").count().collect()                      # at most a row for each ring
    n = dict(zip((rings.cluster * index.rings + rings.ring).tolist(), rings.n.tolist()))
    return sum(r["count"] * n[r["part"]] for r in compared) / pairs if pairs else 0.0


def search_exact(index: BlockIndex, queries: DataFrame, k: int = 5, metric: str = "l2", filters: dict | None = None, mode: str = "null",
                 query_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Exact top-k per query (``query_id, rank, id, distance``), and ``query_id, compared, of``: the
    surviving rows of the rings that the query opened, and all surviving rows."""
    _checked(k, metric)
    if metric == "ip":
        raise ValueError("the bounds hold for distances")
    name, n_of = score_name(metric), "rows"
    blocks = _surviving(index, filters, mode)
    rings = _rings(blocks)
    asked = _queries(queries, query_id)
    first = materialized(_opened(index, asked, rings, lambda q, centroids, own, _: first_rings(q, centroids, own, k)[1]))
    near = materialized(rank_per_query(_topk(index, blocks, first, k, metric, len(rings.n)), k, metric).select("query_id", "id", name))
    limit = near.groupBy("query_id").agg(F.max(name).alias("limit"), F.count(F.lit(1)).alias(n_of)).select(
        F.col("query_id").alias("id"), F.when(F.col(n_of) >= k, F.sqrt("limit") if metric == "l2_squared" else F.col("limit")).alias("limit"))

    def further(q, centroids, own, most):
        bound, done = first_rings(q, centroids, own, k)
        most = np.where(np.isnan(most.astype(float)), np.inf, most.astype(float))
        return ~done & (bound <= most[:, None])

    rest = materialized(_opened(index, asked.join(limit, "id", "left").select("id", "embedding", "limit"), rings, further, limit=True))
    more = _topk(index, blocks, rest, k, metric, len(rings.n))
    hits = rank_per_query(near.unionByName(more), k, metric).select("query_id", "rank", "id", name)
    sizes = F.create_map(*[F.lit(x) for c, r, n in zip(rings.cluster.tolist(), rings.ring.tolist(), rings.n.tolist()) for x in (c * index.rings + r, n)]) \
        if len(rings.n) else F.create_map(F.lit(0), F.lit(0))
    compared = first.select("id", "part").unionByName(rest.select("id", "part")).groupBy("id").agg(
        F.sum(F.element_at(sizes, F.col("part").cast("int"))).cast("long").alias("compared"))
    share = asked.select("id").join(compared, "id", "left").select(
        F.col("id").alias("query_id"), F.coalesce("compared", F.lit(0)).cast("long").alias("compared"), F.lit(int(rings.n.sum())).cast("long").alias("of"))
    return hits, share
