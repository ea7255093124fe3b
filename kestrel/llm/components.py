"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node in ``links``.

    Labels spread along links and then jump to their label's label, until none
    changes. Every step is a join and a grouped minimum (combined before the shuffle,
    so a node with very many links is no hot key) and is written to the shared folder.
    Null ends and links of a node to itself are ignored."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        # the smallest label among a node and its neighbours
        near = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = labels.select(F.col("u").alias("mid"), F.col("label").alias("up"))
        spread = written(step.join(up, "mid", "left").select("u", "old", F.least(F.col("mid"), F.coalesce("up", "mid")).alias("label")),
                         "labels")
        labels = spread.select("u", "label")
        if spread.filter("old <> label").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
