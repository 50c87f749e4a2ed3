"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = (edges.join(least, "b").filter("a > m")
              .select(F.col("m").alias("a"), F.col("a").alias("b")))
    return linked.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node of the component) for every node of
    ``edges`` (columns ``a`` and ``b``). Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path."""
    now = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"),
                                              F.greatest("a", "b").alias("b")).distinct(), "cc")

    def state(e):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    before = state(now)
    for _ in range(max_rounds if before[0] else 0):
        now = saved(_small_star(_large_star(now)), "cc")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node")).distinct()
    return (now.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
