"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is a grouped minimum (combined map-side) and one equi join, so a hub is no single task's work; rounds are
written to the shared folder, and only two numbers per round reach the driver. Rounds grow as the square of the
logarithm of the longest path at most; stars, which the operators here emit, need two or three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link what a node meets to the smallest node it meets: its larger neighbours, or itself and its smaller ones."""
    if large:
        met = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = met.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        links = met.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("low").alias("y"))
    else:
        met = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = met.groupBy("a").agg(F.min("b").alias("low"))
        links = met.join(least, "a").select(F.col("b").alias("x"), F.col("low").alias("y"))
        links = links.union(least.select(F.col("a").alias("x"), F.col("low").alias("y")))
    return links.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of the edges ``a``, ``b`` (longs).

    Nodes without an edge are not in the result; loops and repeated edges have no effect. No edges: no rows.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(state) == mark or not state[0]:
            break
        mark = tuple(state)
        now = stored(_star(_star(now, large=True), large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
