"""Connected components by alternating stars, with stored tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.llm.common import dealt, stored


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(dealt(least), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(dealt(least.withColumnRenamed("u", "c")), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v; longs): root is the smallest node of its component.

    Ends when a round changes nothing; the number of rounds grows with the logarithm of the longest path. Minima are
    combined map-side, so a node with very many neighbours is no single task. No edges pass through the driver.
    """
    edges = stored(links.select("u", "v").filter("u != v").distinct(), "edges")
    mark = _mark(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
