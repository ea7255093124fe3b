"""Approximate search: IVF (D6, D7, C6, A10, A11) and sign-band LSH.

IVF
  build   Lloyd steps over all vectors, from oversampled seeds (k-means||); a step
          assigns vectors on the executors and averages them per cluster. Centroids are
          rounded after each step, so that they depend neither on partitions nor on
          summation order.
          The index is a table partitioned by ``cluster`` plus a centroid table
          (``nlist`` rows: the only data that the driver sees).
  search  queries x their ``nprobe`` nearest clusters are rows, joined with the
          index on ``(cluster, salt)`` in blocks (:func:`knn.block_topk`): a hot
          cluster is many cells, and clusters that no query probes are not compared.

LSH (re-aimed graph index; Charikar's sign projections)
  ``L`` bands of ``b`` hyperplanes each; a band's code packs the ``b`` signs
  of ``<v, plane>``. Planes are +-1 vectors drawn from ``md5(band:bit:dim)``
  so any engine can rebuild them. A query looks up several codes of a band, those
  that flip its least certain bits first; blocks of vectors meet blocks of queries, a
  task counts in how many bands their pairs meet, and pairs that meet often enough are
  scored, exactly.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.vectors import arrow_matrix, block_scores, check_metric, pair_scores
from kestrel.operators.filters import apply_filters
from kestrel.operators.knn import CORPUS_BLOCK, MOST_CELLS, QUERY_BLOCK, block_topk, merged, rank_per_query, score_name
from kestrel.session import materialized, shared_path

# Accepted strategy names (reference aliases map onto ours).
STRATEGY_ALIASES = {"exact": "exact", "flat": "exact", "flat_l2": "exact",
                    "ivf": "ivf", "ivfflat": "ivf", "ivf_flat": "ivf",
                    "lsh": "lsh", "hnsw": "lsh"}

#: Rounds of seeding, and candidates of a round for each centroid.
SEED_ROUNDS, OVERSAMPLE = 4, 2
#: Lloyd steps, and the digits that centroids are rounded to after each.
STEPS, DIGITS = 4, 6
#: Cells that a cluster or a band code is spread over.
SALTS = 8
#: Queries whose probes, and pairs whose scores, are computed at once.
QUERY_TILE, PAIR_TILE = 64, 1 << 14


def strategy_name(name: str) -> str:
    try:
        return STRATEGY_ALIASES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown index type {name!r}") from None


# ---------------------------------------------------------------------------
# IVF
# ---------------------------------------------------------------------------

class IVFIndex:
    """Handle of an IVF index: the assigned table, centroids by cluster, settings."""

    def __init__(self, table: DataFrame, centroids: dict[int, np.ndarray], nlist: int,
                 metric: str = "l2", path: str | None = None):
        self.table, self.centroids = table, centroids
        self.nlist, self.metric, self.path = nlist, metric, path

    def cluster_sizes(self) -> DataFrame:
        return self.table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _nearest(x: np.ndarray, cents: np.ndarray, n: int) -> np.ndarray:
    """Rows of the ``n`` nearest centroids of each vector, ties by row."""
    diff = (np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", cents, cents)[None, :]
            - 2.0 * (x @ cents.T))
    return np.argsort(diff, axis=1, kind="stable")[:, :n]


def _clusters_of(vectors: DataFrame, centroids: dict[int, np.ndarray], n: int) -> DataFrame:
    """``id, cluster, embedding`` once for each of the vector's ``n`` nearest clusters."""
    names = np.array(sorted(centroids), np.int32)
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([centroids[c] for c in names.tolist()]))   # nlist x dim

    def run(batches):
        cents = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            near = _nearest(arrow_matrix(b.column(1), cents.shape[1]), cents, n)
            rows = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(names[near.ravel()]), b.column(1).take(rows)],
                                             ["id", "cluster", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"id long, cluster int, embedding {kind}")


def _unit(round_: int) -> Column:
    """A number from 0 to 2**32 that a vector's id draws in a round, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{round_}"))), 1, 8), 16, 10).cast("double")


def _to_nearest(vectors: DataFrame, centres: np.ndarray, ids: np.ndarray) -> DataFrame:
    """``id, embedding, centre, d2``: each vector's nearest centre and squared distance (6 digits)."""
    shared = vectors.sparkSession.sparkContext.broadcast((centres, ids))

    def run(batches):
        c, names = shared.value
        for b in batches:
            if b.num_rows:
                x = arrow_matrix(b.column(1), c.shape[1])
                d2 = np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2.0 * (x @ c.T), 0.0)
                near = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[near]),
                                                  pa.array(np.round(d2[np.arange(len(x)), near], DIGITS))], ["id", "embedding", "centre", "d2"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInArrow(run, f"id long, embedding {kind}, centre long, d2 double")


def seed_centroids(vectors: DataFrame, nlist: int, rounds: int = SEED_ROUNDS) -> dict[int, np.ndarray]:
    """Starting centroids by oversampling (k-means||, Bahmani et al.): from one vector, each round
    adds vectors on the executors with a chance of ``OVERSAMPLE * nlist * d2 / sum(d2)``; of all
    candidates, those that most vectors are nearest to are taken.

    Draws are hashes of ids and sums are decimal, so the result depends on no partitioning. The
    driver sees about ``OVERSAMPLE * nlist`` vectors a round, whatever the table's size."""
    first = vectors.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":0"))), "id").limit(1).collect()
    if not first:
        raise ValueError("no vectors to train on")
    found = [(r["id"], np.asarray(r["embedding"], np.float64)) for r in first]
    both = lambda: (np.array([v for _, v in found]), np.array([i for i, _ in found], np.int64))
    for k in range(1, rounds + 1):
        near = _to_nearest(vectors, *both())           # computed twice, which is less than to write it
        total = float(near.agg(F.sum(F.col("d2").cast("decimal(28,6)"))).first()[0])
        if total == 0:
            break
        drawn = near.filter(_unit(k) * F.lit(total) < F.lit(float(OVERSAMPLE * nlist * 2 ** 32)) * F.col("d2"))
        found += [(r["id"], np.asarray(r["embedding"], np.float64)) for r in drawn.select("id", "embedding").collect()]
    weights = _to_nearest(vectors, *both()).groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["centre"]: r["n"] for r in weights}
    ranked = sorted(found, key=lambda c: (-n.get(c[0], 0), c[0]))[:nlist]
    return {k: np.round(v, DIGITS) for k, (_, v) in enumerate(ranked)}


def _lloyd(vectors: DataFrame, centroids: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """One step: the rounded means of the vectors nearest to each centroid. Tasks pass on
    sums, ``nlist x dim`` rows at most; a cluster without vectors stays where it is."""
    dim = len(next(iter(centroids.values())))

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, c = arrow_matrix(b.column(1), dim), b.column(0).to_numpy()
            for k in np.unique(c).tolist():
                rows = x[c == k]
                own = total.setdefault(k, np.zeros(dim + 1))
                own[:dim] += rows.sum(axis=0)
                own[dim] += len(rows)
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(keys, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(keys)), pa.int32()),
             pa.array(np.concatenate([np.zeros(0), *(total[k][:dim] for k in keys)])),
             pa.array(np.repeat([int(total[k][dim]) for k in keys], dim), pa.int64())], ["cluster", "d", "s", "n"])

    means = (_clusters_of(vectors, centroids, 1).select("cluster", "embedding")
             .mapInArrow(sums, "cluster int, d int, s double, n long")
             .groupBy("cluster", "d").agg(F.round(F.sum("s") / F.sum("n"), DIGITS).alias("v")).collect())
    out = {c: v.copy() for c, v in centroids.items()}
    for r in means:
        out[r["cluster"]][r["d"]] = r["v"]
    return out


def ivf_build(corpus: DataFrame, nlist: int = 100, steps: int = STEPS, train: DataFrame | None = None) -> IVFIndex:
    """Train centroids on all vectors (or on those of ``train``) and assign every
    vector (D6). Rows without a vector are left out."""
    clean = lambda df: df.select(F.col("id").cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    vectors = materialized(clean(corpus))            # every step reads them
    learn = materialized(clean(train)) if train is not None else vectors
    centroids = seed_centroids(learn, nlist)
    for _ in range(steps):
        centroids = _lloyd(learn, centroids)
    return IVFIndex(_clusters_of(vectors, centroids, 1), centroids, nlist)


def ivf_save(index: IVFIndex, path: str | None = None, spark: SparkSession | None = None) -> IVFIndex:
    """Write the index (A10): table partitioned by cluster (a cluster's rows come from
    ``SALTS`` tasks), centroids, config."""
    spark = spark or index.table.sparkSession
    path = path or shared_path(spark, "indexes/ivf", unique=True)
    (index.table.repartition("cluster", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
     .write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors"))
    spark.createDataFrame([(int(i), [float(v) for v in c]) for i, c in sorted(index.centroids.items())],
                          "cluster int, centroid array<double>").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/centroids")
    cfg = {"nlist": index.nlist, "metric": index.metric, "kind": "ivf"}
    spark.createDataFrame([(json.dumps(cfg),)], "config string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/config")
    return ivf_load(spark, path)


def ivf_load(spark: SparkSession, path: str) -> IVFIndex:
    """Read an index written by :func:`ivf_save`."""
    cfg = json.loads(spark.read.text(f"{path}/config").first()[0])
    centroids = {r["cluster"]: np.asarray(r["centroid"], np.float64)
                 for r in spark.read.parquet(f"{path}/centroids").collect()}              # nlist rows
    return IVFIndex(spark.read.parquet(f"{path}/vectors"), centroids, cfg["nlist"], cfg.get("metric", "l2"), path)


def probes(index: IVFIndex, queries: DataFrame, nprobe: int, query_id: str = "query_id") -> DataFrame:
    """``query_id, cluster, embedding``: the ``nprobe`` nearest clusters of each query."""
    q = queries.select(F.col(query_id).cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    return _clusters_of(q, index.centroids, nprobe).withColumnRenamed("id", "query_id")


def ivf_search(index: IVFIndex, queries: DataFrame, k: int = 5, nprobe: int = 10,
               metric: str = "l2", query_id: str = "query_id") -> DataFrame:
    """Top-k per query through ``nprobe`` clusters (D7): ``query_id, rank, id,
    distance``. ``nprobe >= nlist`` is exhaustive and equals exact search."""
    return block_topk(index.table.select("id", F.col("cluster").alias("part"), "embedding"),
                      probes(index, queries, nprobe, query_id).select(F.col("query_id").alias("id"), F.col("cluster").alias("part"),
                                                                       "embedding"), k, metric, SALTS)


def ivf_share(index: IVFIndex, queries: DataFrame, nprobe: int, query_id: str = "query_id") -> DataFrame:
    """One row ``share``: the part of all (query, vector) pairs that a search compares."""
    sizes = index.cluster_sizes()
    compared = probes(index, queries, nprobe, query_id).join(sizes, "cluster").agg(F.sum("n").alias("n"))
    pairs = queries.filter(F.col("embedding").isNotNull()).agg(F.count(F.lit(1))).scalar() * sizes.agg(F.sum("n")).scalar()
    return compared.select((F.coalesce("n", F.lit(0)) / pairs).alias("share"))


# ---------------------------------------------------------------------------
# LSH: banded sign projections
# ---------------------------------------------------------------------------

@functools.lru_cache(maxsize=4)
def lsh_planes(bands: int, bits: int, dim: int) -> np.ndarray:
    """(bands, bits, dim) of +-1: +1 when the first hex digit of
    ``md5('band:bit:dim')`` is below 8."""
    out = np.empty((bands, bits, dim), dtype=np.float64)
    for l in range(bands):
        for j in range(bits):
            for d in range(dim):
                h = hashlib.md5(f"{l}:{j}:{d}".encode()).hexdigest()
                out[l, j, d] = 1.0 if int(h[0], 16) < 8 else -1.0
    return out


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(n, bands) int64 codes: bit j of band l is ``<x, plane[l, j]> >= 0``."""
    bands, bits, dim = planes.shape
    dots = x @ planes.reshape(bands * bits, dim).T                     # (n, bands*bits)
    signs = (dots >= 0).reshape(x.shape[0], bands, bits).astype(np.int64)
    return (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)


def lsh_codes(corpus: DataFrame, bands: int = 8, bits: int = 6) -> DataFrame:
    """``id, band, code`` for every vector (the LSH index as a table)."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            dim = len(b.column(1)[0])
            codes = _codes(arrow_matrix(b.column(1), dim), lsh_planes(bands, bits, dim))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))),
                 pa.array(codes.ravel())], ["id", "band", "code"])

    return corpus.select(F.col("id").cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull()) \
        .mapInArrow(run, "id long, band int, code long")


#: Bits of a code that a probe may flip: the least certain ones (with at most this many bits, all).
FLIPPED_BITS = 10


def probe_codes(x: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """(n, bands, probes) codes to look up for each vector, its own first: those that flip the bits
    at least total squared distance to their planes (query-directed probing, Lv et al.)."""
    bands, bits, dim = planes.shape
    dots = (x @ planes.reshape(bands * bits, dim).T).reshape(len(x), bands, bits)
    own = ((dots >= 0).astype(np.int64) << np.arange(bits)).sum(axis=2)
    few = min(bits, FLIPPED_BITS)
    unsure = np.argsort(np.abs(dots), axis=2, kind="stable")[:, :, :few]
    masks = (np.arange(1 << few)[:, None] >> np.arange(few)) & 1                     # subsets of these bits
    flips = (np.int64(1) << unsure.astype(np.int64)) @ masks.T
    costs = np.take_along_axis(dots, unsure, 2) ** 2 @ masks.T
    codes = own[:, :, None] ^ flips
    order = np.lexsort((codes, costs), axis=2)[:, :, :probes]
    return np.take_along_axis(codes, order, 2)


def _lsh_blocks(vectors: DataFrame, rows: int, code) -> DataFrame:
    """``vectors`` (``id, embedding, least``) as blocks of about ``rows`` vectors: ``ids, copies, least, matrix, dim,
    codes`` as bytes, by id. Equal rows are one with their number in ``copies``, and all rows of an id are in
    one block, since they meet together. ``code`` gives the codes of a matrix."""
    single = vectors.repartition("id").groupBy("id", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.max("least").alias("least"))

    def packed(parts):
        ids, copies, least, x = (np.concatenate(p) for p in zip(*parts))
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        cuts = starts[np.flatnonzero(np.diff(starts // rows, prepend=-1))]            # at the first row of an id
        ends = [*cuts[1:].tolist(), len(ids)]
        codes = code(x)
        got = [[pa.array([a[s:e].tobytes() for s, e in zip(cuts.tolist(), ends)], pa.binary()) for a in own] for own in ((ids, copies, least), (_narrow(x), codes))]
        return pa.RecordBatch.from_arrays([*got[0], got[1][0], pa.array([x.shape[1]] * len(cuts), pa.int32()), got[1][1]],
                                          ["ids", "copies", "least", "matrix", "dim", "codes"])

    def run(batches):
        held, n = [], 0                                                              # rows that wait for a full block
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            own = [ids, b.column(2).to_numpy(), b.column(3).to_numpy(), arrow_matrix(b.column(1), len(b.column(1)[0]))]
            end = int(np.searchsorted(ids, ids[-1]))                                 # the last id may go on in the next batch
            if n + end >= rows and (end or ids[0] != held[-1][0][-1]):
                yield packed([*held, [a[:end] for a in own]] if end else held)
                held, n, own = [], 0, [a[end:] for a in own]
            held.append(own)
            n += len(own[0])
        if held:
            yield packed(held)

    return single.select("id", "embedding", "copies", "least").sortWithinPartitions("id").mapInArrow(
        run, "ids binary, copies binary, least binary, matrix binary, dim int, codes binary")


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in single width if that holds it."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short if np.array_equal(short, x, equal_nan=True) else x


def _code_type(bits: int):
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int64


def _met_blocks(corpus: DataFrame, queries: DataFrame, bands: int, bits: int, probes: int, query_id: str, least: int | DataFrame,
                fields: tuple[str, ...], then, schema: str, fold=None) -> DataFrame:
    """``then(block, query block, hits, least)`` of each pair of a corpus block and a query block: ``hits`` says in how
    many bands each vector has a code that each query looks up, ``least`` how many are asked for (a number, or a frame
    ``query_id, least`` of the queries to ask). Blocks come with ``fields`` of theirs. With ``fold``, ``then`` gives columns
    instead of batches, and ``fold`` makes one of those of a query block and the corpus blocks that it meets in a row.

    Codes are compared inside the task, so no pair is a row. Corpus blocks are spread over as many cells as the session has
    shuffle partitions (``MOST_CELLS`` at most) and query blocks are copied to each, hence the shuffle grows with the vectors,
    not with the pairs."""
    spark, kind = corpus.sparkSession, _code_type(bits)
    cells = min(MOST_CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clean = lambda df, name: df.select(F.col(name).cast("long").alias("id"), "embedding").filter(F.col("embedding").isNotNull())
    planes = lambda x: lsh_planes(bands, bits, x.shape[1])
    asked = clean(queries, query_id)
    asked = asked.withColumn("least", F.lit(least)) if isinstance(least, int) else asked.join(least.withColumnRenamed("query_id", "id"), "id")
    asked = asked.withColumn("least", F.col("least").cast("int"))

    def looked_up(x):
        return np.concatenate([probe_codes(x[i:i + QUERY_TILE], planes(x), probes) for i in range(0, len(x), QUERY_TILE)]).astype(kind)

    left = _lsh_blocks(clean(corpus, "id").withColumn("least", F.lit(0)), CORPUS_BLOCK, lambda x: _codes(x, planes(x)).astype(kind)) \
        .withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int"))
    right = _lsh_blocks(asked, QUERY_BLOCK, looked_up)
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), *[F.col(c).alias(f"q_{c}") for c in right.columns])
    names = ("ids", "copies", "dim", "codes", *fields)
    # the copies are not in Spark's estimate, by which it would broadcast them; queries are the side that is read once
    pairs = right.hint("merge").join(left, "cell").select(*names, "q_least", *[f"q_{c}" for c in names])

    def block(row, prefix=""):
        out = {"ids": np.frombuffer(row[f"{prefix}ids"], np.int64), "copies": np.frombuffer(row[f"{prefix}copies"], np.int64)}
        codes = np.frombuffer(row[f"{prefix}codes"], kind)
        out["codes"] = codes.reshape(len(out["ids"]), bands, -1) if prefix else codes.reshape(-1, bands)
        if "matrix" in fields:
            flat, dim = row[f"{prefix}matrix"], row[f"{prefix}dim"]
            out["matrix"] = np.frombuffer(flat, np.float32 if len(flat) == 4 * dim * len(out["ids"]) else np.float64).reshape(-1, dim).astype(float)
        return out

    def rows(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])

    def run(batches):
        asking, kept = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
                if row["dim"] != row["q_dim"]:
                    raise ValueError(f"query vectors of size {row['q_dim']} for stored vectors of size {row['dim']}")
                own, q = block(row), block(row, "q_")
                got = then(own, q, _hits(own, q, 1 << bits), np.frombuffer(row["q_least"], np.int32))
                if not fold:
                    yield from got
                    continue
                if kept is not None and row["q_ids"] != asking:
                    yield rows(kept)
                    kept = None
                asking, kept = row["q_ids"], got if kept is None else fold([kept, got])
        if kept is not None:
            yield rows(kept)

    return pairs.mapInArrow(run, schema)


def _firsts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))


def _hits(own: dict, q: dict, n_codes: int) -> np.ndarray:
    """(vectors, queries) in how many bands they meet; rows of one id (or query) share the sum of theirs."""
    n, m, bands = len(own["ids"]), len(q["ids"]), own["codes"].shape[1]
    hits = np.zeros((n, m), np.uint8 if bands < 256 else np.int32)
    who = np.repeat(np.arange(m), q["codes"].shape[2])
    for band in range(bands):
        have, want = own["codes"][:, band], q["codes"][:, band].ravel()
        if n_codes > 1 << 10:                                                        # only codes that are looked up have a row
            names, want = np.unique(want, return_inverse=True)
            at = np.searchsorted(names, have)
            have = np.where(names[np.minimum(at, len(names) - 1)] == have, at, len(names))
            table = np.zeros((len(names) + 1, m), hits.dtype)
        else:
            table = np.zeros((n_codes, m), hits.dtype)
        table[want, who] = 1
        hits += table[have]
    for axis, block in enumerate((own, q)):
        first = _firsts(block["ids"])
        if len(first) < len(block["ids"]) or (block["copies"] > 1).any():
            weighed = hits * (block["copies"][:, None] if axis == 0 else block["copies"])
            hits = np.repeat(np.add.reduceat(weighed, first, axis=axis), np.diff(np.append(first, len(block["ids"]))), axis=axis)
    return hits


def lsh_levels(corpus: DataFrame, queries: DataFrame, bands: int = 8, bits: int = 6, query_id: str = "query_id", probes: int = 1,
               least: int = 1) -> DataFrame:
    """``query_id, level, n``: how many vectors meet a query in ``level`` bands, ``least`` standing for that many or more."""
    def count(own, q, hits, _):
        rows, cols = _firsts(own["ids"]), _firsts(q["ids"])
        some = np.minimum(hits[np.ix_(rows, cols)], least)
        n = np.stack([np.count_nonzero(some == level, axis=0) for level in range(1, least + 1)], axis=1)
        at, level = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q["ids"][cols][at]), pa.array((level + 1).astype(np.int64)), pa.array(n[at, level].astype(np.int64))],
                                         ["query_id", "level", "n"])

    return _met_blocks(corpus, queries, bands, bits, probes, query_id, least, (), count, "query_id long, level long, n long") \
        .groupBy("query_id", "level").agg(F.sum("n").alias("n"))


def _levels_taken(corpus: DataFrame, queries: DataFrame, bands: int, bits: int, query_id: str, probes: int, least: int, enough: int) -> DataFrame:
    """``query_id, least``: in how many bands a pair has to meet so that a query has ``enough`` (1 where it never has)."""
    levels = materialized(lsh_levels(corpus, queries, bands, bits, query_id, probes, least))     # at most ``least`` rows for a query
    above = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return levels.withColumn("above", above).filter(F.col("above") < enough).groupBy("query_id").agg(F.min("level").alias("least"))


def lsh_candidates(corpus: DataFrame, queries: DataFrame, bands: int = 8, bits: int = 6,
                   query_id: str = "query_id", probes: int = 1, least: int = 1, enough: int | None = None) -> DataFrame:
    """``query_id, id, hits``: the pairs that meet in at least ``least`` bands, where a query looks up
    ``probes`` codes of a band (see :func:`_met_blocks`; pairs leave the task that found them and are not shuffled).

    With ``enough``, a query with fewer candidates takes pairs that meet in fewer bands too, down to
    one, until there are that many: what filters leave of the corpus may be little."""
    asked = least if enough is None else _levels_taken(corpus, queries, bands, bits, query_id, probes, least, enough)

    def pairs(own, q, hits, wanted):
        rows, cols = _firsts(own["ids"]), _firsts(q["ids"])
        hits = hits[np.ix_(rows, cols)]
        at, query = np.nonzero(hits >= np.maximum(wanted[cols], 1))
        for i in range(0, len(at), PAIR_TILE):
            r, c = at[i:i + PAIR_TILE], query[i:i + PAIR_TILE]
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"][cols][c]), pa.array(own["ids"][rows][r]), pa.array(hits[r, c].astype(np.int64))],
                                             ["query_id", "id", "hits"])

    return _met_blocks(corpus, queries, bands, bits, probes, query_id, asked, (), pairs, "query_id long, id long, hits long")


#: Part of a block's pairs from which the best are picked by one matrix product before they are scored.
DENSE = 1 / 32


def _best_met(own: dict, q: dict, candidates: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` candidates of each query in a pair of blocks: query, id, score."""
    x, queries = own["matrix"], q["matrix"]
    candidates = candidates & (np.diff(q["ids"], append=q["ids"][-1] + 1) != 0)          # a query has one vector
    if candidates.mean() > DENSE and k < len(x) and np.isfinite(x).all() and np.isfinite(queries).all():
        near = block_scores(queries, x, metric) * (-1.0 if metric == "ip" else 1.0)
        near[~candidates.T] = np.inf
        last = np.partition(near, k - 1, axis=1)[:, k - 1]
        # wider than the rounding of the product
        slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(last), last, 0.0))) + 1e-12 * (np.square(queries).sum(axis=1) + np.square(x).sum(axis=1).max())
        candidates &= (near <= (last + slack)[:, None]).T
    rows, cols = np.nonzero(candidates)
    if (own["copies"] > 1).any():
        many = np.minimum(own["copies"][rows], k)
        rows, cols = np.repeat(rows, many), np.repeat(cols, many)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    score = np.concatenate([pair_scores(x[rows[i:i + PAIR_TILE]], queries[cols[i:i + PAIR_TILE]], metric) for i in range(0, len(rows), PAIR_TILE)])
    ids = own["ids"][rows]
    order = np.lexsort((ids, -score if metric == "ip" else score, cols))
    firsts = np.flatnonzero(np.diff(cols[order], prepend=-1))
    keep = order[np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order)))) < k]
    return q["ids"][cols[keep]], ids[keep], score[keep]


def score_pairs(corpus: DataFrame, queries: DataFrame, pairs: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id") -> DataFrame:
    """Best ``k`` per query among ``pairs`` (``query_id, id``): ``query_id, rank, id, distance``.

    Queries are packed into blocks of ``QUERY_BLOCK``. A vector travels once to each block that has
    it as a candidate, with the numbers of its queries there; a block's vectors are dealt to ``SALTS``
    cells, each headed by the block's query matrix, and scored in NumPy batch by batch. At most ``k``
    rows per query leave a batch."""
    check_metric(metric)
    name = score_name(metric)
    n_queries = queries.filter(F.col("embedding").isNotNull()).count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    none = lambda kind: F.lit(None).cast(kind)
    wanted = pairs.select("query_id", "id", block).groupBy("block", "id").agg(F.collect_list("query_id").alias("wanted"))
    body = (wanted.join(corpus.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
                        .filter(F.col("embedding").isNotNull()), "id")
            .select("block", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "embedding", "wanted"))
    heads = queries.filter(F.col("embedding").isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), "embedding").select(
        block, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("query_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"), none("array<long>").alias("wanted"))

    def run(batches):
        own, place, matrix = None, {}, []
        for b in batches:
            cell = b.column(0).to_numpy().astype(np.int64) * SALTS + b.column(1).to_numpy()
            kind = b.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(cell * 2 + kind)) + 1
            for part in np.split(np.arange(b.num_rows), edges):
                if not len(part):
                    continue
                if cell[part[0]] != own:
                    own, place, matrix = cell[part[0]], {}, []
                some = b.slice(int(part[0]), len(part))
                x = arrow_matrix(some.column(4), len(some.column(4)[0]))
                if kind[part[0]] == 0:
                    place.update(zip(some.column(3).to_pylist(), range(len(place), len(place) + len(x))))
                    matrix.append(x)
                    continue
                q = np.concatenate(matrix)
                matrix = [q]
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"query vectors of size {q.shape[1]} for stored vectors of size {x.shape[1]}")
                lists = some.column(5)
                asked = lists.flatten().to_numpy()
                rows = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
                at = np.fromiter(map(place.__getitem__, asked.tolist()), np.int64, len(asked))
                ids = some.column(3).to_numpy()[rows]
                score = np.concatenate([pair_scores(x[rows[i:i + PAIR_TILE]], q[at[i:i + PAIR_TILE]], metric) for i in range(0, len(rows), PAIR_TILE)])
                order = np.lexsort((ids, -score if metric == "ip" else score, asked))
                firsts = np.flatnonzero(np.diff(asked[order], prepend=asked[order][0] - 1))
                nth = np.arange(len(order)) - np.repeat(firsts, np.diff(np.append(firsts, len(order))))
                keep = order[nth < k]
                yield pa.RecordBatch.from_arrays([pa.array(asked[keep]), pa.array(ids[keep]), pa.array(score[keep])], ["query_id", "id", name])

    dealt = heads.unionByName(body).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")
    return rank_per_query(dealt.mapInArrow(run, f"query_id long, id long, {name} double"), k, metric, name).select("query_id", "rank", "id", name)


#: Candidates of a query, in multiples of k, below which filtered search takes weaker ones too.
ENOUGH = 25


def lsh_search(corpus: DataFrame, queries: DataFrame, k: int = 5, bands: int = 8, bits: int = 6,
               metric: str = "l2", query_id: str = "query_id", candidates: DataFrame | None = None,
               probes: int = 1, least: int = 1, filters: dict | None = None, mode: str = "null") -> DataFrame:
    """Top-k among the candidates of :func:`lsh_candidates` (or among given ones): ``query_id, rank, id,
    distance`` (fewer than k rows when there are fewer candidates). Candidates are scored by the task that finds
    them, and at most k of them per query and cell leave it. ``filters`` are applied first, and weaker
    candidates are taken where fewer than ``ENOUGH * k`` survive."""
    check_metric(metric)
    docs, name = apply_filters(corpus, filters, mode), score_name(metric)
    if candidates is not None:
        return score_pairs(docs, queries, candidates, k, metric, query_id)
    asked = _levels_taken(docs, queries, bands, bits, query_id, probes, least, ENOUGH * k) if filters else least

    def best(own, q, hits, wanted):
        return _best_met(own, q, hits >= np.maximum(wanted, 1), k, metric)

    local = _met_blocks(docs, queries, bands, bits, probes, query_id, asked, ("matrix",), best, f"query_id long, id long, {name} double",
                        lambda parts: merged(parts, k, metric))
    return rank_per_query(local, k, metric, name).select("query_id", "rank", "id", name)
