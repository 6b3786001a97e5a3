"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import forget, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label is the component's smallest node.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so chains shrink by halves.  Labels are written to the shared
    folder every round; only the count of changes reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        least = stage(least, "labels")
        forget(labels)
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = stage(least.join(jump, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        forget(least)
        if not labels.where("label <> old").limit(1).count():
            forget(both)
            out = labels.select("node", "label")
            out._staged = labels._staged
            return out


class Forest:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
