"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.sources.tables import dropped, stored

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, label (bigint): the least node that each node of edges (a, b) can reach. Nodes without edges don't appear.

    Each round every node takes the least label among its neighbours and itself, then the label of that label; rounds end
    when nothing changes. Labels are combined on the map side before they move, so a node with many neighbours is no hot
    key; each round's labels are a stored table. Self-loops, repeated and reversed edges are allowed; no edges, no rows.
    """
    edges = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = stored(own.join(far, "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved")), "labels")
        done = new.filter("moved").isEmpty()
        dropped(labels)
        labels = new
        if done:
            dropped(both)
            return labels.select("node", "label")
    raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
