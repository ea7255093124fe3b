import pytest
from pyspark.sql import functions as F

from conftest import SF01
from kestrel.operators import ann as AN
from kestrel.operators import knn as K
from kestrel.operators import metrics as ME
from kestrel.sources import tables as S


@pytest.fixture(scope="module")
def data(spark):
    corpus = S.corpus(spark, SF01).cache()
    qv = S.query_vectors(spark, SF01).cache()
    truth = ME.exact_truth(K.knn(corpus, qv, k=5)).cache()
    return corpus, qv, truth


@pytest.fixture(scope="module")
def index(data):
    corpus, _, _ = data
    return AN.ivf_save(AN.ivf_build(corpus, nlist=16))


def _r(df):
    return df.withColumn("distance", F.round("distance", 9))


def test_exhaustive_ivf_equals_exact(data, index):
    corpus, qv, _ = data
    a, b = _r(AN.ivf_search(index, qv, k=5, nprobe=16)), _r(K.knn(corpus, qv, k=5))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_reload_equals_original(spark, data, index):
    _, qv, _ = data
    again = AN.ivf_load(spark, index.path)
    a, b = _r(AN.ivf_search(index, qv, k=5, nprobe=4)), _r(AN.ivf_search(again, qv, k=5, nprobe=4))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ivf_floor(data, index):
    _, qv, truth = data
    recall = ME.recall_precision(AN.ivf_search(index, qv, k=5, nprobe=4), truth, 5).first()["recall"]
    share = AN.ivf_share(index, qv, 4).first()["share"]
    assert share <= 0.45 and recall >= share


def test_ivf_training_sees_all_vectors_whatever_the_partitions(spark, data):
    corpus, _, _ = data
    a = {r["id"]: r["cluster"] for r in AN.ivf_build(corpus.repartition(1), nlist=9).table.select("id", "cluster").collect()}
    b = {r["id"]: r["cluster"] for r in AN.ivf_build(corpus.repartition(7), nlist=9).table.select("id", "cluster").collect()}
    assert a == b and len(a) == corpus.filter("embedding IS NOT NULL").count()


def test_lsh_scores_candidates_only(spark, data):
    """The join's output is the distinct pairs that share a band code, and only these are scored."""
    corpus, qv, truth = data
    codes = {}
    for r in AN.lsh_codes(corpus, 8, 6).collect():
        codes.setdefault((r["band"], r["code"]), set()).add(r["id"])
    want = set()
    for r in AN.lsh_codes(qv.withColumnRenamed("query_id", "id"), 8, 6).collect():
        want |= {(r["id"], x) for x in codes.get((r["band"], r["code"]), ())}
    pairs = AN.lsh_candidates(corpus, qv, 8, 6).collect()
    assert {(r["query_id"], r["id"]) for r in pairs} == want and len(pairs) == len(want)
    hits = AN.lsh_search(corpus, qv, k=5, bands=8, bits=6)
    assert {(r["query_id"], r["id"]) for r in hits.collect()} <= want
    share = len(want) / (qv.count() * corpus.filter("embedding IS NOT NULL").count())
    assert share <= 0.3 and ME.recall_precision(hits, truth, 5).first()["recall"] >= 2 * share


def _shuffled(df):
    """Rows that the exchanges of ``df``'s plan wrote."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            rows += p.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows


def _random(spark, n, every, dim=16):
    import numpy as np
    from conftest import vec_frame
    vecs = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    corpus = vec_frame(spark, list(enumerate(vecs.tolist())))
    return vecs, corpus, corpus.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding")


@pytest.mark.parametrize("filtered", [False, True])
def test_lsh_shuffles_vectors_not_pairs(spark, filtered):
    """Most of the 400,000 pairs meet; what is shuffled are vectors and the best rows of each task."""
    _, corpus, queries = _random(spark, 2000, 10)
    corpus = corpus.withColumn("category", F.lit("en"))
    pairs = AN.lsh_candidates(corpus, queries, 8, 4, probes=4).count()
    hits = AN.lsh_search(corpus, queries, 5, 8, 4, probes=4, least=2, filters={"category": "en"} if filtered else None)
    assert pairs > 200_000 and _shuffled(hits) < 20_000
    assert _shuffled(AN.lsh_candidates(corpus, queries, 8, 4, probes=4)) < 20_000
    n = AN.lsh_levels(corpus, queries, 8, 4, probes=4, least=1).agg(F.sum("n")).first()[0]
    assert n == pairs


def test_lsh_copies_queries_a_bounded_number_of_times(spark, monkeypatch):
    _, corpus, queries = _random(spark, 400, 20)
    monkeypatch.setattr(AN, "MOST_CELLS", 2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        hits = AN.lsh_search(corpus, queries, 5, 4, 4)
        # vectors and queries by id, their blocks, two copies of the query blocks, the best rows of each task
        assert _shuffled(hits) <= 420 + 40 + 2 * 20 + 2 * 20 * 5
        assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("bits", [4, 12])
@pytest.mark.parametrize("enough", [None, 40])
def test_lsh_candidates_and_search_equal_brute_force(spark, bits, enough):
    """Rows that repeat meet as often as they are there; blocks are cut between ids, and Arrow batches anywhere."""
    vecs, corpus, queries = _random(spark, 900, 30)
    corpus = corpus.unionByName(corpus.filter("id % 3 = 0")).unionByName(corpus.filter("id % 9 = 0").withColumn("embedding", F.reverse("embedding")))
    queries = queries.unionByName(queries.filter("query_id % 60 = 0"))
    meets, own = {}, {}
    for r in AN.lsh_codes(corpus, 6, bits).collect():
        own.setdefault((r["band"], r["code"]), []).append(r["id"])
    for r in queries.collect():
        import numpy as np
        codes = AN.probe_codes(np.array([r["embedding"]]), AN.lsh_planes(6, bits, 16), 3)[0]
        for band in range(6):
            for code in codes[band].tolist():
                for i in own.get((band, code), ()):
                    meets[r["query_id"], i] = meets.get((r["query_id"], i), 0) + 1
    floor = {}
    for q in {q for q, _ in meets}:
        levels = [min(n, 3) for (a, _), n in meets.items() if a == q]
        floor[q] = 3 if enough is None else next((x for x in (3, 2) if sum(y >= x for y in levels) >= enough), 1)
    # a level without pairs changes nothing
    want = {(q, i, n) for (q, i), n in meets.items() if n >= floor[q]}
    pairs = spark.createDataFrame([(q, i) for q, i, _ in want], "query_id long, id long")
    rows = lambda df: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())
    best = {metric: rows(AN.score_pairs(corpus, queries, pairs, 7, metric)) for metric in ("l2", "ip") if enough is None}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = AN.lsh_candidates(corpus, queries, 6, bits, probes=3, least=3, enough=enough).collect()
        assert len(got) == len(want) and {(r["query_id"], r["id"], r["hits"]) for r in got} == want
        for metric in best:
            assert rows(AN.lsh_search(corpus, queries, 7, 6, bits, metric, probes=3, least=3)) == best[metric]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_lsh_self_is_candidate(data):
    corpus, qv, _ = data
    top = AN.lsh_search(corpus, qv, k=1).filter("rank = 1")
    assert top.filter("query_id <> id").count() == 0


def test_strategy_aliases():
    assert AN.strategy_name("hnsw") == "lsh" and AN.strategy_name("ivfflat") == "ivf"
    assert AN.strategy_name("flat") == "exact"
    with pytest.raises(ValueError):
        AN.strategy_name("annoy")


def test_hot_cluster_split_over_batches(spark):
    """Two thirds of the vectors sit in one tight cluster; with small Arrow
    batches that cluster spans many batches and tasks, and exhaustive IVF
    still equals exact search."""
    import numpy as np
    from conftest import vec_frame
    rng = np.random.default_rng(7)
    hot = rng.normal(0, 0.01, size=(400, 8)) + 5.0
    rest = rng.normal(0, 1.0, size=(200, 8))
    vecs = np.vstack([hot, rest])
    corpus = vec_frame(spark, list(enumerate(vecs.tolist()))).repartition(6)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs[::37].tolist())],
                                    "query_id long, embedding array<float>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        index = AN.ivf_save(AN.ivf_build(corpus, nlist=4))
        assert max(r["n"] for r in index.cluster_sizes().collect()) >= 200
        a, b = _r(AN.ivf_search(index, queries, k=7, nprobe=4)), _r(K.knn(corpus, queries, k=7))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_lsh_rows_that_leave_a_task_do_not_grow_with_corpus_blocks(spark, monkeypatch):
    monkeypatch.setattr(AN, "CORPUS_BLOCK", 8)
    monkeypatch.setattr(AN, "MOST_CELLS", 2)
    merge, left = AN.rank_per_query, []
    monkeypatch.setattr(AN, "rank_per_query", lambda df, *a: (left.append(df), merge(df, *a))[1])
    _, corpus, queries = _random(spark, 400, 10)
    hits = AN.lsh_search(corpus, queries, 5, 8, 4, probes=16)
    # every pair meets, and 50 corpus blocks have 5 of each of 40 queries
    assert left[-1].count() <= 2 * 40 * 5
    assert [tuple(r)[:3] for r in hits.orderBy("query_id", "rank").collect()] == \
        [tuple(r)[:3] for r in K.knn(corpus, queries, 5).orderBy("query_id", "rank").collect()]
