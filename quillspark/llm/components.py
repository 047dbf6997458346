"""Connected components by label propagation with pointer jumping, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "component") -> DataFrame:
    """(id, label) for every vertex of the edges: label is the smallest id that can be reached.

    Null ends and loops are ignored; repeated edges change nothing; no edges give no rows. Each
    round takes the smallest label among neighbours and then the label of that label, so the number
    of rounds grows with the logarithm of a component's width.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("near")).select(F.col("x").alias("id"), F.least("x", "near").alias(label)), "labels")
    while True:
        near = both.join(labels.select("id", label), both["y"] == F.col("id")).groupBy("x").agg(F.min(label).alias("near"))
        new = labels.select("id", label).join(near, F.col("id") == near["x"]).select("id", F.col(label).alias("old"), F.least(label, "near").alias("new"))
        new, last = materialize(new, "labels"), labels
        jump = new.select(F.col("id").alias("at"), F.col("new").alias("next"))
        labels = materialize(new.join(jump, new["new"] == jump["at"]).select("id", "old", F.least("new", "next").alias(label)), "labels")
        discard(last, new)
        if labels.where(F.col(label) != F.col("old")).isEmpty():
            discard(both)
            return labels.select("id", label)
