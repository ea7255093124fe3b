"""Write PLANS.md: the executed physical plans (after AQE) of key queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 python explain_plans.py
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans import catalog as C  # noqa: E402
from kestrel.session import get_spark  # noqa: E402

KEY = ["knn_l2", "knn_single", "knn_filtered", "ivf_search", "ivf_filtered", "ivf_adaptive", "ann_lsh", "lsh_filtered", "keyword_match", "keyword_rank", "hybrid_rrf",
       "rag_prompts", "embed_documents", "latency_summary", "corpus_stats", "stored_filter_category", "stored_filter_author", "embed_cached"]
NOTES = ("PushedFilters", "PartitionFilters", "ReadSchema")


def tidy(plan: str) -> str:
    plan = re.sub(r"#\d+L?", "", plan)
    plan = re.sub(r"\[plan_id=\d+\]", "", plan)
    # scan lines stay whole: they carry PushedFilters / PartitionFilters / ReadSchema
    return "\n".join(line if "Scan" in line else line[:160] for line in plan.splitlines())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(master="local[8]", shuffle_partitions=16)
    out = ["# Executed plans", "", f"`{sf_dir}`, local[8], after AQE (generated by explain_plans.py).", ""]
    for name in KEY:
        df = C.QUERIES[name](spark, sf_dir)
        df.collect()                      # runs this frame's own plan, which is then final
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=false" not in plan.splitlines()[0], name       # a pruning subquery has a plan of its own
        plan = plan.split("+- == Initial Plan ==")[0]
        ops = [op for op in ("BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin",
                             "WindowGroupLimit", "TakeOrderedAndProject", "MapInArrow", "Exchange")
               if op in plan]
        out += [f"## {name}", "", "operators: " + ", ".join(f"{o} x{plan.count(o)}" for o in ops), "",
                "```", tidy(plan), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
