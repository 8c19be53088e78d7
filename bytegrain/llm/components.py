"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.session import Stage


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of the edges (a, b); a label is its component's least node.

    In each round a node takes its least neighbour (minima form before the shuffle, so a hub
    is no hot group), edges take the labels of their ends, and what became a loop is dropped.
    Every component at least halves; rounds end when no edge is left. Nothing is collected.
    """
    left = Stage(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    labels = None
    while True:
        both = left.df.union(left.df.select("b", "a"))
        least = Stage(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least")),
            f"{name}-least",
        )
        known = least.df
        if labels is None:
            labels = Stage(known.select("node", F.col("least").alias("label")), f"{name}-labels")
        else:
            before, step = labels, known.withColumnRenamed("node", "_label")
            labels = Stage(
                before.df.join(step, F.col("label") == F.col("_label"), "left").select(
                    "node", F.coalesce("least", "label").alias("label")
                ),
                f"{name}-labels",
            )
            before.drop()
        of_a = known.select(F.col("node").alias("a"), F.col("least").alias("_a"))
        of_b = known.select(F.col("node").alias("b"), F.col("least").alias("_b"))
        contracted = left.df.join(of_a, "a").join(of_b, "b").where("_a <> _b")
        after = Stage(
            contracted.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(),
            f"{name}-edges",
        )
        left.drop()
        least.drop()
        left = after
        if left.df.isEmpty():
            left.drop()
            return labels.df
