"""Connected components of an edge table: smallest label of a component, by hooking and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (smallest node reachable) of every node of edges (a, b); any order, repeats allowed.

    Alternates large-star and small-star steps over the edge table: each is one aggregation with
    map-side combining and one join, and edges never outnumber the input's. An empty table gives an
    empty result; edges with a null end are ignored."""
    e = edges.where("a is not null and b is not null")
    e = checkpointed(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        # Large star: neighbours larger than a node hang from the smallest of it and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        # Small star: a node and its smaller neighbours hang from the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
        new = checkpointed(small.where("a > b").distinct())
        # Stars only: every node has one parent, and no parent has one itself.
        ends = new.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        e = new
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
