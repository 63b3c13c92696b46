"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewatch.session import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a long, b long)``; the component is its smallest node.

    Each round, every node looks at its neighbour that comes first in an order and both ends of each edge move
    to what they look at; edges inside one node vanish. The first order is that of the nodes themselves, which
    finishes stars around their smallest node; later ones are hashed anew, so a long path halves about each round.
    Rounds write tables to the shared folder, so a lost executor repeats one round at most.
    """
    edges = stage(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges"
    )
    at = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("at")), f"{name}-at")
    turn = 0
    while not edges.isEmpty():
        rank = (lambda c: F.col(c)) if turn == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("b"))).alias("m"))
        moves = stage(first.where(F.col("m.r") < rank("a")).select("a", F.col("m.b").alias("to")), f"{name}-moves")
        moved = lambda df, c, m=moves: df.join(m.select(F.col("a").alias(f"{c}__"), "to"), F.col(c) == F.col(f"{c}__"), "left").withColumn(
            c, F.coalesce("to", c)).drop("to", f"{c}__")
        at = stage(moved(at, "at"), f"{name}-at")
        ends = moved(moved(edges, "a"), "b").where("a <> b")
        edges = stage(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
        turn += 1
    least = at.groupBy("at").agg(F.min("node").alias("component"))
    return at.join(least, "at").select("node", "component")
