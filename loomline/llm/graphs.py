"""Connected components by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (the smallest node reachable) of every node of the edges (a, b); no row for other nodes.

    Each round takes the smallest label among the neighbours and then the label's own label, so long chains close in
    logarithmically many rounds. A round's labels are a written table; rounds end when no label changes.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = settle(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), f"{name}-labels")
        forget(before)
        before, labels = moved, moved.select("node", "label")
        if moved.filter("was <> label").isEmpty():
            forget(both)
            return labels.withColumnRenamed("label", "component")
