import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.operators import metrics as ME


def samples(spark, engine, values):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(engine, "flat", t0 + dt.timedelta(seconds=i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "engine string, index_type string, ts timestamp, sample_id long, seconds double")


def test_p50_of_1_to_100_is_51(spark):
    s = samples(spark, "e", range(1, 101))
    p = ME.latency_percentiles(s, warmup=0).first()
    assert p["p50_ms"] == 51000.0 and p["p95_ms"] == 96000.0 and p["p99_ms"] == 100000.0


def test_cold_warm_split_and_throughput(spark):
    s = samples(spark, "e", [10, 10, 10, 10, 10, 1, 1, 2])
    r = ME.latency_summary(s, warmup=5).first()
    assert r["cold_ms"] == pytest.approx(10000.0)
    assert r["warm_ms"] == pytest.approx(4000.0 / 3)
    assert r["throughput_qps"] == pytest.approx(3 / 4)


def test_few_samples_have_no_warm_rows(spark):
    r = ME.latency_summary(samples(spark, "e", [1, 2, 3]), warmup=5).first()
    assert r["warm_ms"] is None and r["p50_ms"] is None and r["throughput_qps"] == 0.0


def test_ordinals_span_partitions(spark):
    s = samples(spark, "e", range(500)).repartition(7)
    out = ME.ordinal_in_group(s, ["engine"], ["seconds", "sample_id"], "pos")
    got = sorted((r["seconds"], r["pos"]) for r in out.collect())
    assert [p for _, p in got] == list(range(1, 501))


def test_positions_and_ranks_in_very_large_groups(spark):
    """2.4 million rows, 1.6 million of them in one group, against plain windows."""
    s = spark.range(2_400_000, numPartitions=9).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("b").alias("engine"), F.col("id").alias("sample_id"),
        (F.pmod(F.xxhash64("id"), F.lit(700_000)) / 8).alias("seconds"))
    w = Window.partitionBy("engine")
    pos = ME.ordinal_in_group(s, ["engine"], ["seconds", "sample_id"], "pos")
    want = s.withColumn("pos", F.row_number().over(w.orderBy("seconds", "sample_id")).cast("long"))
    same = pos.join(want.select("sample_id", F.col("pos").alias("w")), "sample_id").filter("pos = w")
    assert same.count() == 2_400_000
    rank = ME.rank_in_group(s, ["engine"], "seconds", tie_cols=["sample_id"])
    want = s.withColumn("w", F.rank().over(w.orderBy(F.desc("seconds"))).cast("long")).select("sample_id", "w")
    assert rank.join(want, "sample_id").filter("rank = w").count() == 2_400_000


def test_null_groups_and_ties(spark):
    rows = [(None, 1, 2.0), (None, 2, 2.0), ("a", 3, 1.0), ("a", 4, 3.0), (None, 5, 9.0)]
    s = spark.createDataFrame(rows, "engine string, sample_id long, seconds double").repartition(3)
    got = {r["sample_id"]: r["pos"] for r in ME.ordinal_in_group(s, ["engine"], ["seconds", "sample_id"], "pos").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3}


def test_recall_sets(spark):
    res = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 11), (2, 1, 20), (3, 1, 30)],
                                "query_id long, rank long, id long")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 21), (4, 40)], "query_id long, id long")
    r = ME.recall_precision(res, truth, k=5).first()
    # q1: {10,11} & {10,12} -> 1 of 2; q2: 0 of 1; q4: no results -> 0; q3 has no truth -> skipped
    assert r["n_queries"] == 3
    assert r["recall"] == pytest.approx((0.5 + 0 + 0) / 3)
    assert r["precision"] == pytest.approx((1 / 5) / 3)
    assert r["mrr"] == pytest.approx((1.0 + 0 + 0) / 3)
    assert 0.0 <= r["f1"] <= 1.0


def test_empty_truth_gives_zero(spark):
    res = spark.createDataFrame([(1, 1, 10)], "query_id long, rank long, id long")
    truth = spark.createDataFrame([], "query_id long, id long")
    r = ME.recall_precision(res, truth, k=5).first()
    assert r["recall"] == 0.0 and r["n_queries"] == 0 and r["f1"] == 0.0


def test_percentiles_by_selection_equal_a_sort(spark):
    import random
    r = random.Random(4)
    groups = {"even": [r.random() for _ in range(500)], "equal": [2.0] * 40, "skewed": [10.0 ** r.uniform(-9, 6) for _ in range(300)],
              "ties": [r.choice([0.1, 0.2, 0.3]) for _ in range(99)], "one": [1.5] * 6, "far": [1.0] * 50 + [1e300] * 2,
              "missing": [None] * 10 + [1.0] * 30, "cold": [1.0] * 3, "endless": [1.0, 2.0, float("inf")] * 9}
    rows, i = [], 0
    for g, values in groups.items():
        for k, v in enumerate(values):
            rows.append((g, "flat", k, i, v))
            i += 1
    df = spark.createDataFrame(rows, "engine string, index_type string, ts long, sample_id long, seconds double").repartition(5)
    got = {r["engine"]: (r["p50_ms"], r["p95_ms"], r["p99_ms"]) for r in ME.latency_percentiles(df).collect()}
    want = {}
    for g, values in groups.items():
        warm = sorted(values[5:], key=lambda v: (v is not None, v or 0.0))
        if warm:
            want[g] = tuple(None if (v := warm[int(len(warm) * p)]) is None else v * 1000.0 for p in (0.5, 0.95, 0.99))
    assert got == want
    plan = ME.latency_percentiles(df.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan                  # only the wanted bins were sorted, before


def test_truth_and_results_are_computed_once(spark):
    res = spark.createDataFrame([(1, 1, 10), (1, 2, 10)], "query_id long, rank long, id long")
    truth = spark.createDataFrame([(1, 10), (1, 12), (None, 5)], "query_id long, id long").mapInArrow(lambda b: b, "query_id long, id long")
    q = ME.quality(res, truth, 5)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in q.collect()} == {(1, 2, 1, 1), (None, 1, 0, None)}
