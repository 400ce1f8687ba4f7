"""Distributed connected components by alternating large-star and small-star steps.

Every step is two aggregations and two joins on the edges that are left; nothing is
collected to the driver but whether any edges are left to move. Each round is a
written table, so a lost executor costs a round at most. A node that a large share of
all edges lead to is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.salting import salted_join
from codeweft.sources.scratch import Workspace, steady


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)``: each linked id with the smallest id of its component.

    Self-loops, repeated and null edges have no effect; ids without a link to
    another id aren't returned. Ids compare by their column type's order.
    """
    linked = edges.where("a is not null and b is not null and a <> b")
    e = ws.put(linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    with steady(ws.spark):
        while True:
            last, e = e, ws.put(_small_star(_large_star(e)))
            ws.drop(last)
            ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
            seen = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
            if seen.where("ups > 1 or (ups = 1 and low = 0)").isEmpty():  # only stars are left
                break
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(e.select("v", "v").distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node's neighbourhood."""
    both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    larger = e.select(F.col("v").alias("x"), F.col("u").alias("y"))
    return salted_join(larger, least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(e, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", "m")).distinct()
