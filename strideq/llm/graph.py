"""Connected components of a large edge list, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideq.llm.common import hint_small, remove, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for every node of the edges (``a``, ``b``).

    Large-star and small-star steps in turn: every node ends up beside the least node of
    its component. Each step is a grouped minimum and a join, edges never leave the
    executors, and the number of steps grows with the logarithm of the longest path. A
    minimum is taken by each task before rows meet, and minima are written before they meet
    the edges: if their bytes are few they are broadcast, else the join's sides are plain
    shuffles, of which a node with very many neighbours can be split among tasks. If the
    edges still change after ``rounds`` steps, that is an error: classes are never cut short.
    """
    spark = edges.sparkSession
    e, at = saved(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        # Large star: larger neighbours of every node move to its least neighbour.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large, large_at = _moved(both.filter("b > a"), least)
        large, own_at = saved(large, "large")
        # Small star: smaller neighbours of every node, and itself, move to the least one.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small, small_at = _moved(down, least)
        after, path = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        n = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for gone in (at, large_at, own_at, small_at):
            remove(spark, gone)
        e, at = after, path
        if before == n:
            break
        before = n
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds; give more")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _moved(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, str]:
    """The end of every edge, with the minimum ``m`` of its node, as an edge; and the folder
    with the minima."""
    least, at = saved(least, "least")
    met = edges.join(hint_small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.filter("a <> b").distinct(), at
