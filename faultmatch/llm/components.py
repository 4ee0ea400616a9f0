"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultmatch.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``u, v``: each node that is not the least of its component, with that least node.

    ``edges`` has long columns ``u`` and ``v``; loops and repeated edges do no
    harm.  Each round halves the paths at least in practice; a node with very
    many neighbours is met by pre-aggregated minima and by joins that Spark can
    split.  Rounds are written, so that lost executors cost no more than one.
    """
    now, mark = written(edges.select("u", "v").filter("u <> v").distinct(), name), None
    while True:
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (row.n, row.x) or row.n == 0:
            return now
        mark = (row.n, row.x)
        now = written(_small_star(_large_star(now)).distinct(), name)
