"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm import common


def _stars(held: DataFrame) -> bool:
    """Whether every edge leads to the root of its component: no node has two roots, none is a root and a leaf."""
    if not held.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return held.join(held.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = common.cut) -> DataFrame:
    """node, root (the least node of its component), of every node but the roots, written by ``cut``. edges: u, v, of any direction.

    Each round shortens every path about by half; a round's edges are a written table, deleted
    at the end.  Only whether all are stars reaches the driver.  The least neighbours are
    written, so the join with them has both sides dealt for it alone and Spark can split a
    node with many edges.  Loops are ignored; no edges give no rows.
    """
    with common.Scratch(edges.sparkSession) as s:
        least = lambda e: s.cut(e.groupBy("u").agg(F.min("v").alias("m")))
        held = s.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        while not _stars(held):
            both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = s.cut(both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
            m = least(large)
            small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
            held = s.cut(small.distinct())
        return cut(held.select(F.col("u").alias("node"), F.col("v").alias("root")))
