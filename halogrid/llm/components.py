"""Connected components of a link table: minimum labels of neighbours, then labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (u, v); root is the smallest node reachable.

    A round takes the least label of each node's neighbours (an aggregate with map-side combination over an equi-join
    of written tables, which adaptive execution can split at a node with very many links) and then follows each label
    to its own label, so that distances halve.  Links of a node with itself do not count.
    """
    both = links.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    edges = scratch.write(both.distinct())
    # The first labels: each node's least neighbour, or itself.
    label = scratch.write(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("root")))
    for _ in range(max_rounds):
        near = edges.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        near = label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        first = scratch.write(near)
        if first.where("old <> root").isEmpty():
            return label
        jump = first.join(first.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
        new = scratch.write(jump.select("node", F.coalesce("to", "root").alias("root")))
        scratch.drop(label, first)
        label = new
    raise RuntimeError("components did not settle")
