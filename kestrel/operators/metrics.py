"""Evaluation: retrieval quality (C7, H1, E8, E9), latency (E5-E7, E10,
E11, F3, G6, I18), the strategy matrix (E12, H2) and the report (A13).

Latency samples are a table ``engine, index_type, ts, sample_id, seconds``.
The first ``warmup`` samples of each configuration in time order are cold.
Percentiles follow the reference rule ``sorted[int(n * p)]`` over the warm
samples (not ``percentile_disc``: for 1..100 at 0.5 this gives 51).

A configuration may hold a third of all samples, so ordinals within a group
are never computed by a window over the whole group (one task); see
:func:`ordinal_in_group`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import materialized

WARMUP = 5
PERCENTILES = (("p50_ms", 0.50), ("p95_ms", 0.95), ("p99_ms", 0.99))
LATENCY_TARGET_MS = 20.0
#: Bins of a configuration's samples in the search for percentiles.
BINS = 1024


# ---------------------------------------------------------------------------
# ordinals within groups, spread over many tasks
# ---------------------------------------------------------------------------

def ordinal_in_group(df: DataFrame, group_cols: list[str], order_cols: list,
                     name: str = "ordinal") -> DataFrame:
    """1-based position of each row within its group in ``order_cols`` order.

    ``order_cols`` must make rows unique within a group (end with an id). A
    range-partitioned sort on group and order spreads a group of any size over
    many tasks. The *sorted* frame is materialised once, so that the counts and
    the numbering see the same partitions; per (partition, group) counts, one row
    for each, give every slice its offset by a running sum."""
    keys = [*group_cols, *order_cols]            # order entries may be Columns (e.g. desc)
    ordered = materialized(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_mid", F.monotonically_increasing_id()))
    slices = ordered.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"),
                                                      F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group_cols)],
                            "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    same = F.col("_pid") == F.col("_p")
    for k, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return (ordered.join(offsets, same)
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("long"))
            .select(*df.columns, name))


def rank_in_group(df: DataFrame, group_cols: list[str], score: str, descending: bool = True,
                  tie_cols: list[str] | None = None, name: str = "rank") -> DataFrame:
    """SQL ``rank()`` over ``score`` within each group: the smallest position
    among rows of equal score (positions from :func:`ordinal_in_group`, the
    minimum combined map-side), so no task ever holds a whole group. Null scores
    come last (first if ascending) and tie; a null group is a group."""
    order = [F.col(score).desc() if descending else F.col(score).asc()]
    pos = materialized(ordinal_in_group(df, group_cols, [*order, *(tie_cols or [])], "_pos"))
    keys = [*group_cols, score]
    first = pos.groupBy(*keys).agg(F.min("_pos").alias(name)).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], name)
    # null groups and null scores are keys too
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return pos.join(first, same).select(*df.columns, name)


# ---------------------------------------------------------------------------
# retrieval quality
# ---------------------------------------------------------------------------

def exact_truth(exact_hits: DataFrame) -> DataFrame:
    return exact_hits.select("query_id", "id").distinct()


def quality(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: ``query_id, n_truth, n_hit, first_hit`` where ``n_hit`` =
    |results[:k] ∩ truth| (duplicates collapse) and ``first_hit`` the best
    rank of a relevant result. Queries with empty truth are left out. Both sides
    are used once, so an exact search behind ``truth`` runs once."""
    res = results.filter(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    t = truth.select("query_id", "id").distinct()
    return (t.join(res, ["query_id", "id"], "left")
            .groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"), F.count("rank").alias("n_hit"), F.min("rank").alias("first_hit")))


def recall_precision(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: ``k, n_queries, recall, precision, f1, mrr``.
    Precision divides by ``k`` even with fewer hits; ``k <= 0`` gives 0; F1
    is taken from the mean recall and precision (0 when both are 0); MRR
    averages ``1 / first relevant rank`` (0 when none)."""
    q = quality(results, truth, max(k, 0))
    agg = q.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("n_hit") / F.col("n_truth")).alias("recall"),
        F.avg(F.col("n_hit") / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias("precision"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))).alias("mrr"))
    r, p = F.coalesce(F.col("recall"), F.lit(0.0)), F.coalesce(F.col("precision"), F.lit(0.0))
    return agg.select(
        F.lit(int(k)).cast("long").alias("k"), "n_queries", r.alias("recall"), p.alias("precision"),
        F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(F.lit(0.0)).alias("f1"),
        F.coalesce(F.col("mrr"), F.lit(0.0)).alias("mrr"))


# ---------------------------------------------------------------------------
# latency
# ---------------------------------------------------------------------------

def samples_from_events(events: DataFrame, index_type: str = "flat") -> DataFrame:
    """Stand-in samples: ``engine = event_type``, ``seconds = value``, time
    order ``(ts, event_id)``."""
    return events.select(F.col("event_type").alias("engine"), F.lit(index_type).alias("index_type"),
                         "ts", F.col("event_id").alias("sample_id"), F.col("value").alias("seconds"))


_GROUP = ["engine", "index_type"]


def sequenced(samples: DataFrame) -> DataFrame:
    """Adds ``seq``: 1-based position in time order per configuration."""
    return ordinal_in_group(samples, _GROUP, ["ts", "sample_id"], "seq")


def split_warmup(samples: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """Adds ``cold``: whether a sample is among the first ``warmup`` of its
    configuration in time order. Only these first samples are found (the limited
    window keeps ``warmup`` rows of each group per task); the others are compared
    with the last of them."""
    first = Window.partitionBy(*_GROUP).orderBy("ts", "sample_id")
    edge = (samples.select(*_GROUP, "ts", "sample_id").withColumn("n", F.row_number().over(first))
            .filter(F.col("n") <= max(warmup, 0)).groupBy(*_GROUP).agg(F.max(F.struct("ts", "sample_id")).alias("edge")))
    return (samples.join(edge, _GROUP, "left")
            .withColumn("cold", F.coalesce(F.struct("ts", "sample_id") <= F.col("edge"), F.lit(False)))
            .drop("edge"))


def latency_percentiles(samples: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """``engine, index_type, p50_ms, p95_ms, p99_ms`` over warm samples (E7): the samples at
    the wanted positions of the sorted warm samples.

    Selection instead of a sort: samples are counted in ``BINS`` bins of equal width for each
    configuration, and only the bins that hold a wanted position are sorted, by range. Null
    samples come first, as in a sort."""
    warm = split_warmup(samples, warmup).filter(~F.col("cold")).select(*_GROUP, "seconds", "sample_id")
    spans = warm.groupBy(*_GROUP).agg(F.min("seconds").alias("_low"), F.max("seconds").alias("_high"), F.count(F.lit(1)).alias("n"))
    step = F.floor((F.col("seconds") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS)
    bin_ = (F.when(F.col("seconds").isNull(), -1).when(F.col("seconds") == F.col("_low"), 0).when(F.isnan("seconds"), BINS)
            .otherwise(F.least(F.greatest(F.coalesce(step, F.lit(BINS - 1)), F.lit(0)), F.lit(BINS - 1))))
    binned = warm.join(spans, _GROUP).withColumn("bin", bin_.cast("int"))
    # at most BINS + 2 rows for each configuration
    counts = binned.groupBy(*_GROUP, "n", "bin").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*_GROUP).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = lambda p: F.floor(F.col("n") * F.lit(p)).cast("long") + 1
    held = [(F.col("before") < position(p)) & (position(p) <= F.col("before") + F.col("_c")) for _, p in PERCENTILES]
    wanted = counts.withColumn("before", before).filter(held[0] | held[1] | held[2]).select(*_GROUP, "bin", "before")
    few = binned.join(wanted, [*_GROUP, "bin"]).select(*_GROUP, "bin", "before", "n", "seconds", "sample_id")
    ranked = ordinal_in_group(few, [*_GROUP, "bin"], ["seconds", "sample_id"], "pos")
    aggs = [F.max(F.when(F.col("before") + F.col("pos") == position(p), F.col("seconds") * 1000.0)).alias(name) for name, p in PERCENTILES]
    return ranked.groupBy(*_GROUP).agg(*aggs)


def latency_summary(samples: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """``engine, index_type, cold_ms, warm_ms, p50_ms, p95_ms, p99_ms,
    throughput_qps`` ordered by ``warm_ms`` (E5, E6, G6, I18)."""
    cold = F.col("cold")
    base = split_warmup(samples, warmup).groupBy(*_GROUP).agg(
        (F.avg(F.when(cold, F.col("seconds"))) * 1000.0).alias("cold_ms"),
        (F.avg(F.when(~cold, F.col("seconds"))) * 1000.0).alias("warm_ms"),
        F.count(F.when(~cold, F.lit(1))).alias("_n_warm"),
        F.sum(F.when(~cold, F.col("seconds"))).alias("_t_warm"))
    out = base.join(latency_percentiles(samples, warmup), _GROUP, "left")
    qps = F.when(F.coalesce(F.col("_t_warm"), F.lit(0.0)) > 0, F.col("_n_warm") / F.col("_t_warm")) \
        .otherwise(F.lit(0.0))
    return (out.select("engine", "index_type", "cold_ms", "warm_ms", "p50_ms", "p95_ms", "p99_ms",
                       qps.alias("throughput_qps"))
            .orderBy("warm_ms", "engine", "index_type"))


def latency_speedup(summary: DataFrame, base_engine: str, base_index: str = "flat") -> DataFrame:
    """``engine, index_type, warm_ms, speedup`` against one base configuration
    (E10); the base value is a scalar subquery (no join, no global window)."""
    base = (summary.filter((F.col("engine") == base_engine) & (F.col("index_type") == base_index))
            .agg(F.max("warm_ms")).scalar())
    return summary.select("engine", "index_type", "warm_ms", (base / F.col("warm_ms")).alias("speedup"))


def latency_target_check(summary: DataFrame, target_ms: float = LATENCY_TARGET_MS) -> DataFrame:
    """``engine, index_type, warm_ms, target_ms, meets_target``."""
    return summary.select("engine", "index_type", "warm_ms", F.lit(float(target_ms)).alias("target_ms"),
                          (F.col("warm_ms") <= F.lit(float(target_ms))).alias("meets_target"))


# ---------------------------------------------------------------------------
# report
# ---------------------------------------------------------------------------

def report_rows(latency: DataFrame, recall: DataFrame) -> DataFrame:
    """Flat report: ``section, engine, index_type, metric, value``. The
    recall metric is named ``recall@{k}`` like the reference field (A13)."""
    lat_metrics = ["cold_ms", "warm_ms", "p50_ms", "p95_ms", "p99_ms", "throughput_qps"]
    lat = latency.select(
        F.lit("latency").alias("section"), "engine", "index_type",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                            for m in lat_metrics])).alias("kv"))
    rec = recall.select(
        F.lit("recall").alias("section"), "engine", "index_type",
        F.explode(F.array(
            F.struct(F.concat(F.lit("recall@"), F.col("k").cast("string")).alias("metric"),
                     F.col("recall").alias("value")),
            F.struct(F.lit("avg_precision").alias("metric"), F.col("precision").alias("value")))).alias("kv"))
    return lat.unionByName(rec).select("section", "engine", "index_type", "kv.metric", "kv.value")


def report_json(latency: DataFrame, recall: DataFrame, dataset_size: DataFrame, dimension: int,
                num_queries: DataFrame) -> DataFrame:
    """Nested report, one row: the header ``dataset_size, dimension, num_queries``
    (the sizes are one-row frames) and two arrays of structs (A13)."""
    lat = latency.agg(F.array_sort(F.collect_list(F.struct(*latency.columns))).alias("latency_results"))
    rec = recall.agg(F.array_sort(F.collect_list(F.struct(*recall.columns))).alias("recall_results"))
    return lat.select(dataset_size.scalar().alias("dataset_size"), F.lit(int(dimension)).cast("long").alias("dimension"),
                      num_queries.scalar().alias("num_queries"), "latency_results",
                      rec.scalar().alias("recall_results"))
