"""Connected components of a link table, distributed: alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import checkpointed


def _distinct(df: DataFrame) -> DataFrame:
    return df.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node that has a link; links: two bigint columns a, b. root is the smallest node of its component.

    Each round is two minima and two joins; a checkpoint in the shared folder ends its lineage. Minima are pre-aggregated and the joins
    have one row a key on one side, so a hub's rows can be split among tasks. The number of rounds grows with the log of the size."""
    edges = checkpointed(_distinct(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = checkpointed(_distinct(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
