"""Connected components of an edge table by minimum labels and pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node that it is connected with.

    Each round takes the least label among neighbours and then the label of that label, so that the rounds grow
    with the logarithm of the diameter. Loops, repeated edges and an empty table are allowed; null ends are left out.
    """
    both = edges.dropna(subset=["a", "b"])
    both = stage(both.union(both.select("b", "a")).toDF("node", "other").distinct(), "edges")
    last = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    labels = last
    while True:
        near = both.join(labels.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        jump = labels.toDF("label", "further")
        step = stage(step.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "old"), "labels")
        discard(last)
        if step.where("label <> old").isEmpty():
            discard(both)
            out = step.select("node", "label")
            out.staged_at = step.staged_at
            return out
        last, labels = step, step.select("node", "label")
