"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is run to completion through the ``noop`` sink (no collect), so
the time is the Spark job, not the transfer to Python. Besides wall times the
line carries the batch-search figures the baseline asks for, on an enlarged
corpus (stored vectors repeated with noise, 384 components): pairs per second
of exact search, and time, recall@5 and compared share of IVF and LSH.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kestrel.operators import ann as AN  # noqa: E402
from kestrel.operators import block_index as BI  # noqa: E402
from kestrel.operators import knn as K  # noqa: E402
from kestrel.operators import metrics as ME  # noqa: E402
from kestrel.plans import catalog as C  # noqa: E402
from kestrel.session import get_spark, materialized  # noqa: E402
from kestrel.sources import tables as S  # noqa: E402

HEADLINE = ["knn_batch", "knn_single", "knn_filtered", "ivf_search", "ann_lsh", "postings", "keyword_rank",
            "hybrid_rrf", "rag_prompts", "latency_summary", "filter_conjunction", "corpus_stats",
            "search_by_id", "recall_at_k"]

# The enlarged corpus: stored vectors repeated with noise and widened, so that exact, IVF
# and LSH search differ by more than the fixed cost of a job.
COPIES, WIDE = 25, 384
SETTINGS = ((100, 10), (200, 20))
# codes that a query looks up in each of 8 bands of 16 bits
LSH_PROBES = 4


def _passthrough(batches):
    import kestrel.operators.knn  # noqa: F401  (imports the worker-side modules once)
    yield from batches


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def enlarged(spark, sf_dir):
    """``id, embedding``: every vector ``COPIES`` times, ``WIDE`` components made of its own
    64 and of hashed noise."""
    v = S.read_table(spark, sf_dir, "embeddings")
    noise = lambda i: (F.pmod(F.xxhash64("vec_id", "copy", i), F.lit(1000)) / 1000 - 0.5) * 0.1
    wide = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda i: (
        F.get("embedding", F.pmod(i, F.size("embedding"))) + noise(i)).cast("float"))
    return v.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).select(
        (F.col("vec_id") * COPIES + F.col("copy")).alias("id"), wide.alias("embedding"))


def timed(df):
    """The rows of ``df`` materialised, and the seconds that took."""
    t0 = time.perf_counter()
    out = materialized(df)
    return out, round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    # session start-up, not timed: JVM code paths and the Python workers
    run(S.corpus(spark, sf_dir).select("id"))
    run(spark.range(0, 8 * 1000, numPartitions=cpus).mapInArrow(_passthrough, "id long"))

    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(C.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    # exact, IVF and LSH over the enlarged corpus; queries: every id divisible by 50
    extra: dict = {}
    corpus, extra["enlarge_s"] = timed(enlarged(spark, sf_dir))
    queries = materialized(corpus.filter(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id"))
    n_corpus, n_q = corpus.count(), queries.count()
    extra |= {"n_corpus": n_corpus, "n_queries": n_q, "dim": WIDE}
    exact, extra["exact_s"] = timed(K.knn(corpus, queries, k=5))
    truth = ME.exact_truth(exact)
    extra["exact_pairs_per_sec"] = round(n_corpus * n_q / extra["exact_s"])
    extra["exact_ms_per_query"] = round(1000 * extra["exact_s"] / n_q, 4) if n_q else None
    for nlist, nprobe in SETTINGS:
        key = f"ivf_{nlist}_{nprobe}"
        t0 = time.perf_counter()
        index = BI.build(corpus, nlist)
        extra[f"{key}_build_s"] = round(time.perf_counter() - t0, 3)
        hits, extra[f"{key}_s"] = timed(BI.search(index, queries, k=5, nprobe=nprobe))
        extra[f"{key}_ms_per_query"] = round(1000 * extra[f"{key}_s"] / n_q, 4) if n_q else None
        extra[f"{key}_recall5"] = round(ME.recall_precision(hits, truth, 5).first()["recall"], 4)
        extra[f"{key}_share"] = round(BI.share(index, queries, 5, nprobe), 4)
    found = BI.search_exact(index, queries, 5)[0]
    _, extra["ivf_adaptive_s"] = timed(found)
    pairs, extra["lsh_candidates_s"] = timed(AN.lsh_candidates(corpus, queries, 8, 16, probes=LSH_PROBES))
    hits, extra["lsh_s"] = timed(AN.lsh_search(corpus, queries, 5, 8, 16, candidates=pairs))
    extra["lsh_recall5"] = round(ME.recall_precision(hits, truth, 5).first()["recall"], 4)
    extra["lsh_share"] = round(pairs.count() / (n_corpus * n_q), 6) if n_corpus and n_q else 0.0

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_wall", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
