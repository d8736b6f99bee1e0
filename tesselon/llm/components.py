"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch


def components(edges: DataFrame, keep: Scratch, name: str = "cc-labels") -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b) that has a neighbour; comp is the smallest node reachable.

    Each round gives a node the smallest of itself and its neighbours as parent, follows that parent's parent, and
    contracts the edges to parents; edges within a parent vanish. A star takes one round. Nothing is gathered per
    node but a minimum, and the smallest node of a component stays its own parent throughout. The result is stored
    under ``name``; what led to it is dropped.
    """
    own = Scratch(keep.spark)
    left = own(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        parents = own(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("comp")), "cc-parents")
        above = parents.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        parents = own(parents.join(above, "comp").select("node", F.col("top").alias("comp")), "cc-parents")
        if labels is None:
            labels = parents
        else:
            labels = own(labels.join(parents.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "cc-labels")
        for end in ("a", "b"):
            left = left.join(parents.select(F.col("node").alias(end), F.col("comp").alias("top")), end).drop(end).withColumnRenamed("top", end)
        left = own(left.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    out = keep(labels, name)
    own.drop("cc-edges", "cc-parents", "cc-labels")
    return out
