"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them. Rows are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Both steps keep the number of edges linear, and rounds grow with the logarithm of the longest path. A round ends
    in a written table. It stops when each node hangs on one root and no root hangs on another.
    """
    a, b = F.col("a"), F.col("b")
    now = kept(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        loose = now.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        if loose and now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        now = kept(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(b.alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(a.alias("node"), b.alias("root")).unionByName(roots)
