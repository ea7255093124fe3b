import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01, vec_frame
from kestrel.functions.vectors import distance
from kestrel.operators import knn as K
from kestrel.sources import tables as S

# tiny_vectors: 6 ids in 2-d; ids 2 and 3 are at equal distance from the origin query
TINY = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [2.0, 2.0]), (5, [-3.0, 0.0]), (6, [5.0, 5.0])]


def knn_sql(corpus, queries, k, metric):
    """The same rows from all pairs of a small query set."""
    name = K.score_name(metric)
    q = queries.select("query_id", F.col("embedding").alias("q_emb"))
    pairs = (corpus.filter("embedding IS NOT NULL").select("id", "embedding").crossJoin(q)
             .select("query_id", "id", distance(metric, "embedding", "q_emb").alias(name)))
    return K.rank_per_query(pairs, k, metric, name).select("query_id", "rank", "id", name)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("query_id", "rank").collect()]


def test_tie_break_by_id_and_self_hit(spark):
    corpus = vec_frame(spark, TINY)
    q = spark.createDataFrame([(10, [0.0, 0.0])], "query_id long, embedding array<float>")
    out = rows(K.knn(corpus, q, k=3), "id", "distance")
    assert [r[0] for r in out] == [1, 2, 3]          # 2 and 3 tie at 1.0: lower id first
    assert out[0][1] == 0.0


def test_k_exceeds_n(spark):
    corpus = vec_frame(spark, TINY)
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert len(rows(K.knn(corpus, q, k=50), "id")) == 6


def test_metrics_values(spark):
    corpus = vec_frame(spark, TINY)
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<float>")
    l2 = dict(rows(K.knn(corpus, q, k=6, metric="l2"), "id", "distance"))
    sq = dict(rows(K.knn(corpus, q, k=6, metric="l2_squared"), "id", "distance"))
    ip = rows(K.knn(corpus, q, k=6, metric="ip"), "id", "score")
    assert l2[4] == pytest.approx(np.sqrt(2)) and sq[4] == pytest.approx(2.0)
    assert [i for i, _ in ip][:2] == [6, 4]            # descending inner product


def test_wrong_dimension_raises(spark):
    corpus = vec_frame(spark, TINY + [(7, [1.0, 2.0, 3.0])])
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception):
        K.knn(corpus, q, k=2).collect()


def test_unknown_metric():
    with pytest.raises(ValueError):
        K.score_name("cosine") and K.check_metric("cosine")


@pytest.fixture(scope="module")
def fixture(spark):
    return S.corpus(spark, SF01).cache(), S.query_vectors(spark, SF01).cache()


def test_arrow_equals_sql(fixture):
    corpus, qv = fixture
    for metric in ("l2", "l2_squared", "ip"):
        name = K.score_name(metric)
        a = K.knn(corpus, qv, k=5, metric=metric).withColumn(name, F.round(name, 9))
        b = knn_sql(corpus, qv, 5, metric).withColumn(name, F.round(name, 9))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_blocks_and_cells_do_not_change_the_result(fixture, monkeypatch):
    corpus, qv = fixture
    one = K.knn(corpus, qv, k=5, salts=1)
    monkeypatch.setattr(K, "CORPUS_BLOCK", 37)
    monkeypatch.setattr(K, "QUERY_BLOCK", 3)
    many = K.knn(corpus.repartition(5), qv.repartition(3), k=5, salts=11)
    assert one.exceptAll(many).count() == 0 and many.count() == one.count()


def test_no_job_runs_while_the_plan_is_built(spark, fixture):
    corpus, qv = fixture
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "plan-only")
    K.knn(corpus, qv, k=5, filters={"category": "en"})
    assert sc.statusTracker().getJobIdsForGroup("plan-only") == []
    sc.setJobGroup("other", "other")


def test_single_equals_batch_of_one(fixture):
    corpus, qv = fixture
    vec = qv.filter("query_id = 50").first()["embedding"]
    single = [(r["id"], round(r["distance"], 9)) for r in K.knn_single(corpus, vec, k=5).orderBy("rank").collect()]
    batch = [(r["id"], round(r["distance"], 9))
             for r in K.knn(corpus, qv.filter("query_id = 50"), k=5).orderBy("rank").collect()]
    assert single == batch


def test_topk_prefix_and_filter_subset(fixture):
    corpus, qv = fixture
    k5 = K.knn(corpus, qv, k=5)
    k6 = K.knn(corpus, qv, k=6).filter("rank <= 5")
    assert k5.exceptAll(k6).count() == 0
    filt = {"category": "en"}
    hits = K.knn(corpus, qv, k=5, filters=filt).select("id").distinct()
    allowed = corpus.filter("category = 'en'").select("id")
    assert hits.join(allowed, "id", "left_anti").count() == 0


def test_search_by_id_self_first(fixture, spark):
    corpus, _ = fixture
    ids = corpus.filter("embedding IS NOT NULL").select("id")
    out = K.search_by_id(corpus, ids, k=3).filter("rank = 1")
    assert out.filter("query_id <> id OR distance <> 0").count() == 0


def test_unknown_ids_strict(fixture, spark):
    corpus, _ = fixture
    ids = spark.createDataFrame([(0,), (10 ** 9,)], "id long")
    assert [r["id"] for r in K.unknown_ids(corpus, ids).collect()] == [10 ** 9]
    with pytest.raises(KeyError):
        K.search_by_id(corpus, ids, k=2)


def test_single_query_plan_is_take_ordered(fixture):
    corpus, qv = fixture
    vec = qv.first()["embedding"]
    plan = K.knn_single(corpus, vec, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_batch_plan_uses_window_group_limit(fixture):
    corpus, qv = fixture
    plan = K.knn(corpus, qv, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_that_leave_a_task_do_not_grow_with_corpus_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "CORPUS_BLOCK", 8)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    merge = K.rank_per_query
    left = []
    monkeypatch.setattr(K, "rank_per_query", lambda df, *a: (left.append(df), merge(df, *a))[1])
    vec = lambda i: [float(i * 37 % 101), float(i * 53 % 89)]
    corpus = vec_frame(spark, [(i, vec(i)) for i in range(400)])
    qv = vec_frame(spark, [(i, vec(i)) for i in (0, 50, 100, 150, 150, 200)]).withColumnRenamed("id", "query_id").coalesce(1)
    hits = K.knn(corpus, qv, k=3, salts=2)
    # 6 rows, 5 queries, 2 cells; 50 corpus blocks
    assert left[-1].count() <= 6 * 2 * 3
    x = np.array([vec(i) for i in range(400)])
    for q in (0, 50, 100, 200):
        want = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in range(400))[:3]
        got = [(r["distance"], r["id"]) for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want])
