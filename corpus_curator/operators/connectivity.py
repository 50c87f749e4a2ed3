"""Strongly connected components of a directed graph, distributed.

Vertices that nothing enters or leaves are components of their own (trim). Every
other vertex takes the least colour among those that reach it (a fresh random
order of the vertices each time, so that long paths fall apart at several places
at once); what reaches a colour's own vertex back, inside the colour, is one
component. Edges between colours go, and the rest starts again. All graphs
(``task``) run at once; only counts reach the driver. The number of passes grows
with the longest shortest path of a component, a few for graphs of random pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_UNROLL = 2  # propagation steps per written table
_TRIMS = 3


def _trim(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(single vertices, other vertices, edges among those)."""
    inner = materialize(
        vertices.join(edges.select("task", F.col("b").alias("id")).distinct(), ["task", "id"])
        .join(edges.select("task", F.col("a").alias("id")).distinct(), ["task", "id"]))
    left = materialize(
        edges.join(inner.select("task", F.col("id").alias("a")), ["task", "a"])
        .join(inner.select("task", F.col("id").alias("b")), ["task", "b"])
        .select("task", "a", "b"))
    return vertices.join(inner, ["task", "id"], "left_anti"), inner, left


def _least_colours(vertices: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """``(task, id, c)``: the least vertex, in the order of ``turn``, that reaches each."""
    own = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")
    now = materialize(vertices.withColumn("c", own))
    while True:
        after = now.withColumn("was", F.col("c"))
        for _ in range(_UNROLL):
            sent = (edges.join(after.select("task", F.col("id").alias("a"), "c"), ["task", "a"])
                    .groupBy("task", F.col("b").alias("id")).agg(F.min("c").alias("m")))
            after = (after.join(sent, ["task", "id"], "left")
                     .withColumn("c", F.least("c", F.coalesce("m", "c"))).drop("m"))
        after = materialize(after)
        now = after.drop("was")
        if not after.filter(F.col("c") != F.col("was")).limit(1).count():
            return now


def _reaching(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that reach the vertex of their colour over ``edges`` (inside colours)."""
    now = materialize(colours.withColumn("r", F.col("id") == F.col("c.id")))
    while True:
        after = now.withColumn("was", F.col("r"))
        for _ in range(_UNROLL):
            sent = (edges.join(after.filter("r").select("task", F.col("id").alias("b")),
                               ["task", "b"])
                    .select("task", F.col("a").alias("id"), F.lit(True).alias("m")).distinct())
            after = (after.join(sent, ["task", "id"], "left")
                     .withColumn("r", F.col("r") | F.coalesce("m", F.lit(False))).drop("m"))
        after = materialize(after)
        now = after.drop("was")
        if not after.filter(F.col("r") != F.col("was")).limit(1).count():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """``(task, id, component)`` of every vertex of ``edges`` (``task, a, b``): the
    smallest id of its strongly connected component."""
    links = edges.select("task", "a", "b")
    vertices = materialize(links.select("task", F.col("a").alias("id"))
                           .union(links.select("task", F.col("b").alias("id"))).distinct())
    links = materialize(links.filter("a <> b").distinct())
    found, turn = [], 0
    while True:
        # one trim can free others; what is left of a chain falls to the colours
        for _ in range(_TRIMS):
            before = links.count()
            single, vertices, links = _trim(vertices, links)
            found.append(single.select("task", "id", F.col("id").alias("label")))
            left = links.count()
            if left == before:
                break
        if not left:
            break
        colours = _least_colours(vertices, links, turn)
        side = colours.select("task", "id", F.col("c.id").alias("c"))
        inside = materialize(
            links.join(side.select("task", F.col("id").alias("a"), F.col("c").alias("ca")),
                       ["task", "a"])
            .join(side.select("task", F.col("id").alias("b"), F.col("c").alias("cb")),
                  ["task", "b"])
            .filter("ca = cb").select("task", "a", "b"))
        reached = _reaching(colours, inside)
        found.append(reached.filter("r").select("task", "id", F.col("c.id").alias("label")))
        vertices = materialize(reached.filter("not r").select("task", "id"))
        links = materialize(
            inside.join(vertices.select("task", F.col("id").alias("a")), ["task", "a"])
            .join(vertices.select("task", F.col("id").alias("b")), ["task", "b"])
            .select("task", "a", "b"))
        turn += 1
    labels = materialize(reduce(DataFrame.unionByName, found))
    least = labels.groupBy("task", "label").agg(F.min("id").alias("component"))
    return labels.join(least, ["task", "label"]).select("task", "id", "component")
