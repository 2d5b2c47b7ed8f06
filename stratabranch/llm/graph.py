"""Connected components of an edge table, by rounds of hooking to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import cut

ROUNDS = 60


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """v, root for every vertex of edges (a, b: longs); root is the component's smallest vertex.

    Alternates two steps until neither changes the edges: every vertex hands its larger neighbours
    to its smallest one (large star), then its smaller neighbours to the smallest of them (small
    star). Each step joins edges with the minimum of a vertex, so a hub's edges are rows of a join,
    which can be split, and never a list in one task. Edges are checkpointed every round.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = cut(small)
        n, total = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
