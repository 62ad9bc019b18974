"""Connected components of an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node that node is linked to.

    Large-star and small-star steps in turn: every node links its greater (then its lesser)
    neighbours to the least of them, until each node links to its root alone. Each step groups
    by node, which combines before the shuffle, and looks the least up, where a hot node's rows
    are dealt over tasks. Edges are written after each round, so a lost executor costs one round.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n")))
        large = lookup(both, least, ["a"], ["b"], "inner", "n").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
        joined = lookup(large, least, ["a"], ["b"], "inner", "n")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(joined.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        after = written(small)
        if _same(now, after):
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Edge sets of equal size and equal sums of hashes are taken as equal."""
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(sign(x)) == tuple(sign(y))
