"""Connected components of an edge table by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): each vertex of ``edges`` and the smallest vertex it reaches.

    A round takes the smallest label among a vertex and its neighbours, then the
    label of that label; rounds grow with the logarithm of a component's width.
    Every round is a written table, so a lost executor costs one round at most.
    """
    both = stored(edges.select(F.col(a).alias("v"), F.col(b).alias("w"))
                  .unionByName(edges.select(F.col(b).alias("v"), F.col(a).alias("w"))).distinct(), "edges")
    labels = stored(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("w"), F.col("label").alias("near")), "w")
                .groupBy("v").agg(F.min("near").alias("near")))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = stored(step.join(jump, "label", "left").select("v", "old", F.least("label", "far").alias("label")), "labels")
        if new.filter("old <> label").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")
