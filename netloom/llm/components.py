"""Connected components of links, as joins and aggregates of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the smallest node of its component, of each node that has a link.

    Labels fall to the smallest among the neighbours, and then to the label of that label, until none changes. Links and
    labels stay in the cluster; the driver sees one count a round."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = common.materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = common.materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")), "labels")
    while True:
        said = labels.select(F.col("node").alias("y"), F.col("label").alias("theirs"))
        low = both.join(said, "y").groupBy(F.col("x").alias("node")).agg(F.min("theirs").alias("low"))
        lower = labels.join(low, "node").select("node", "label", F.least("label", "low").alias("next"))
        lower = common.materialize(lower, "lower")
        of = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        jumped = lower.join(of, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), (F.col("label") != F.least("next", F.coalesce("beyond", "next"))).alias("changed"))
        jumped = common.materialize(jumped, "jumped")
        common.drop(labels, lower)
        labels = jumped.select("node", "label")
        if jumped.where("changed").isEmpty():
            common.drop(both)
            return labels
