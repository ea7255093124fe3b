"""The stored block index: pruning, filters, the stop bound, seeds, and the recall of the registered settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import vec_frame
from kestrel.operators import ann as AN
from kestrel.operators import block_index as BI
from kestrel.operators import hybrid as HY
from kestrel.operators import knn as K
from kestrel.operators import metrics as ME
from kestrel.plans import catalog as C
from kestrel.sources import tables as S

SF1 = "/root/testdata/sf0.1"
HALF, ONE_PERCENT = {"category": "en"}, {"author": "author3", "category": "es"}


@pytest.fixture(scope="module")
def data(spark):
    return S.corpus(spark, SF1), S.query_vectors(spark, SF1)


@pytest.fixture(scope="module")
def index(data):
    return BI.build(data[0], C.NLIST)


def _same(a, b):
    r = lambda d: sorted((x["query_id"], x["rank"], x["id"], round(x[3], 9)) for x in d.select("query_id", "rank", "id", d.columns[3]).collect())
    return r(a) == r(b)


def _recall(hits, corpus, queries, filters=None):
    return ME.recall_precision(hits, ME.exact_truth(K.knn(corpus, queries, k=5, filters=filters)), 5).first()["recall"]


@pytest.mark.parametrize("filters", [None, HALF, ONE_PERCENT, {"date_to": "2020-06-01"}])
def test_registered_settings_recall(data, index, filters):
    corpus, queries = data
    hits = BI.search(index, queries, 5, C.NPROBE, filters=filters)
    share = BI.share(index, queries, 5, C.NPROBE, filters=filters)
    assert _recall(hits, corpus, queries, filters) >= 0.9
    assert filters or share <= 0.3
    lsh = AN.lsh_search(corpus, queries, 5, C.BANDS, C.BITS, probes=C.PROBES, least=C.LEAST, filters=filters)
    assert _recall(lsh, corpus, queries, filters) >= 0.9
    if not filters:
        pairs = AN.lsh_candidates(corpus, queries, C.BANDS, C.BITS, probes=C.PROBES, least=C.LEAST).count()
        assert pairs <= 0.3 * queries.count() * index.rows


@pytest.mark.parametrize("filters", [None, HALF, ONE_PERCENT, {"author": "nobody"}])
@pytest.mark.parametrize("metric", ["l2", "l2_squared"])
def test_stop_bound_equals_exact_search(data, index, filters, metric):
    corpus, queries = data
    hits, share = BI.search_exact(index, queries, 7, metric, filters)
    assert _same(hits, K.knn(corpus, queries, 7, metric, filters))
    rows = share.collect()
    assert len(rows) == queries.count() and all(r["compared"] <= r["of"] for r in rows)


def test_stop_bound_skips_rings_of_clustered_vectors(spark):
    """Vectors in tight groups: few rings can hold a neighbour, and the others stay closed."""
    rng = np.random.default_rng(5)
    groups = rng.normal(0, 10, size=(12, 16))
    vecs = np.vstack([g + rng.normal(0, 0.1, size=(60, 16)) for g in groups])
    corpus = vec_frame(spark, list(enumerate(vecs.tolist()))).repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs[::45].tolist())], "query_id long, embedding array<float>")
    hits, share = BI.search_exact(BI.build(corpus, 12), queries, 5)
    assert _same(hits, K.knn(corpus, queries, 5))
    part = share.agg((F.sum("compared") / F.sum("of")).alias("s")).first()["s"]
    assert part < 0.25


def test_a_probe_reads_one_cluster(spark, data, index):
    """One query, one probe: the scan of the blocks is pruned by the clusters of the queries."""
    _, queries = data
    one = queries.filter("query_id = 50")
    hits = BI.search(index, one, 3, 1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("ReadSchema")[0] and "cluster" in plan
    rows = hits.collect()
    scans = [n for n in _nodes(hits._jdf.queryExecution().executedPlan()) if "FileSourceScan" in n.getClass().getSimpleName()]
    found = [n.metrics().apply("numPartitions").value() for n in scans if n.metrics().contains("numPartitions")]
    assert found and min(found) <= 2 < index.nlist           # the nearest cluster's folder (another if it holds fewer than k)
    assert rows[0]["id"] == 50


def _nodes(plan):
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.length())]
    return out


def test_reopened_index_and_hot_cluster(spark):
    """Two thirds of the vectors lie together, also with one more vector than a block holds."""
    rng = np.random.default_rng(7)
    vecs = np.vstack([rng.normal(0, 0.01, size=(BI.BLOCK + 300, 8)) + 5.0, rng.normal(0, 1.0, size=(600, 8)), np.ones((20, 8))])
    corpus = vec_frame(spark, list(enumerate(vecs.tolist()))).unionByName(
        spark.createDataFrame([(10**6, None)], "id long, embedding array<float>")).repartition(6)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs[::97].tolist())] + [(999, None)],
                                    "query_id long, embedding array<float>")
    index = BI.load(spark, BI.build(corpus, 4).path)
    want = K.knn(corpus, queries, 7)
    assert _same(BI.search(index, queries, 7, 4), want) and _same(BI.search_exact(index, queries, 7)[0], want)
    with pytest.raises(ValueError):
        BI.search(index, queries, 7, 4, filters={"author": "x"})
    with pytest.raises(ValueError):
        BI.search(index, queries, 0)


def test_text_mode_filters(spark, data):
    from kestrel.sources import ingest as I
    docs, queries = I.collection(spark, "/root/testdata/sf0.01"), S.query_vectors(spark, "/root/testdata/sf0.01")
    filters = {"date_to": "2021-06-30", "tags": "src3"}
    index = BI.build(docs, 10)
    assert _same(BI.search_exact(index, queries, 5, filters=filters, mode="text")[0], K.knn(docs, queries, 5, filters=filters, mode="text"))


def test_oversampled_seeds(spark, data):
    """Lower mean distance than vectors drawn by hash, and the same whatever the partitions."""
    vectors = data[0].filter("embedding IS NOT NULL").select("id", "embedding")
    x = np.array([r["embedding"] for r in vectors.orderBy(F.md5(F.col("id").cast("string"))).collect()])

    def mean(c):
        return np.sqrt(np.maximum(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1), 0)).mean()

    def steps(c):
        for _ in range(AN.STEPS):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        return mean(c)

    seeds = AN.seed_centroids(vectors, 60)
    assert steps(np.array(list(seeds.values()))) < steps(x[:60])
    again = AN.seed_centroids(vectors.repartition(7), 60)
    assert all((seeds[k] == again[k]).all() for k in seeds) and len(again) == 60
    few = AN.seed_centroids(vectors.filter("id < 6 or id = 7"), 60)
    assert len(few) == 7


def test_probes_are_the_cheapest_codes():
    rng = np.random.default_rng(2)
    x, planes = rng.normal(size=(20, 8)), AN.lsh_planes(3, 6, 8)
    got = AN.probe_codes(x, planes, 9)
    for i in range(20):
        for b in range(3):
            dots = planes[b] @ x[i]
            own = sum(int(d >= 0) << j for j, d in enumerate(dots))
            cost = {own ^ m: sum(d * d for j, d in enumerate(dots) if m >> j & 1) for m in range(64)}
            assert got[i, b].tolist() == sorted(cost, key=cost.get)[:9]
            assert got[i, b, 0] == own


def test_retrieve_by_strategy(spark, data, index):
    corpus, queries = data
    few = queries.limit(4)
    exact = HY.retrieve(corpus, few, 3, False, strategy="flat")
    assert {r["strategy"] for r in exact.collect()} == {"exact"} and _same(exact.drop("strategy"), K.knn(corpus, few, 3))
    ivf = HY.retrieve(corpus, few, 3, False, strategy="ivf_flat", ann=index, nprobe=index.nlist)
    assert {r["strategy"] for r in ivf.collect()} == {"ivf"} and _same(ivf.drop("strategy"), K.knn(corpus, few, 3))
    assert {r["strategy"] for r in HY.retrieve(corpus, few, 3, False, strategy="ivf").collect()} == {"exact"}
    assert {r["strategy"] for r in HY.retrieve(corpus, few, 3, False, strategy="hnsw", bands=8, bits=4, probes=4).collect()} == {"lsh"}
    for k in (0, 101):
        with pytest.raises(ValueError):
            HY.retrieve(corpus, few, k)


def test_opened_rings_leave_a_task_in_small_batches():
    """Queries that open all rings: what is handed on at once doesn't grow with queries and rings."""
    import types

    import pyarrow as pa
    n, n_rings, dim = 500, 1600, 4
    context = types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x))
    kind = types.SimpleNamespace(dataType=types.SimpleNamespace(simpleString=lambda: "array<float>"))
    queries = types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=context), schema={"embedding": kind}, mapInArrow=lambda run, schema: run)
    index = BI.BlockIndex(None, np.eye(200, dim), 1.0, "", 10**6, 8)
    rings = BI._Rings(np.repeat(np.arange(200), 8), np.tile(np.arange(8), 200), np.full(n_rings, 9), np.zeros(n_rings), np.ones(n_rings))
    run = BI._opened(index, queries, rings, lambda q, centroids, own, _: np.ones((len(q), len(own.n)), bool))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([[0.0] * dim] * n, pa.list_(pa.float32()))], ["id", "embedding"])
    sizes, last = [], {}
    for b in run([batch]):
        sizes.append(b.num_rows)
        for i, p, nth in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
            assert nth == last.get(i, -1) + 1 == p
            last[i] = nth
    assert sum(sizes) == n * n_rings and max(sizes) <= 1 << 13 and set(last.values()) == {n_rings - 1}
