"""Connected components of a graph of links between 64-bit nodes, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); equal roots mean one component.

    Each round every node moves to its smallest neighbour, or stays if it is smaller itself; links are redrawn between
    where their ends went. Node numbers should be hashes: then each round removes a constant share of the nodes in
    expectation, chains included. All tables that meet in a join are checkpointed first, so nothing is computed twice,
    a lost executor costs one step, and adaptive execution can split the partition of a node with very many links.
    Links from a node to itself, repeated ones and both directions of one change nothing; nodes without another are not in
    the result, and no links give an empty one. Node numbers must not be null.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = kept(both.where("a <> b").distinct())
    at = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not links.isEmpty():
        went = kept(links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("from"), F.least("a", "low").alias("to")))
        at = kept(
            at.join(went, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        left = kept(links.join(went, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b"))
        right = left.join(went, F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
        links = kept(right.where("a <> b").distinct())
    return at
