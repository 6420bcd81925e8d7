"""Connected components of a graph given by edges, without any vertex's edges meeting in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import materialise


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, root) of every vertex of edges (a, b); root is the least vertex of its component.

    Rounds: each vertex points to its least neighbour if that is less than itself, pointers are followed to their roots by
    doubling, and edges between roots go to the next round. Minima are combined before the shuffle, so a vertex with
    very many edges is no task of its own.
    """
    pairs = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges")
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        up = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("p")), f"{name}-up")
        while True:
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            further = materialise(up.join(over, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), f"{name}-up")
            moved = not further.filter("moved").isEmpty()
            up = further.drop("moved")
            if not moved:
                break
        rounds.append(up)
        there = pairs.join(up.withColumnRenamed("v", "a").withColumnRenamed("p", "pa"), "a").join(up.withColumnRenamed("v", "b").withColumnRenamed("p", "pb"), "b")
        pairs = materialise(there.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges")
    if not rounds:
        return pairs.select(F.col("a").alias("v"), F.col("b").alias("root"))

    def onward(labels: DataFrame, later: DataFrame) -> DataFrame:
        later = later.select(F.col("v").alias("root"), F.col("p").alias("_to"))
        return labels.join(later, "root", "left").select("v", F.coalesce("_to", "root").alias("root"))

    return reduce(onward, rounds[1:], rounds[0].withColumnRenamed("p", "root"))
