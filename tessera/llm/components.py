"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches.

    Alternates large-star and small-star steps: every node links its larger (or
    smaller) neighbours to the smallest node it sees, until nothing changes.
    Smallest neighbours are found by an aggregate that combines map-side and are
    joined back, so a hub's neighbours are never gathered in one task (adaptive
    execution splits a skewed side of that join). Each step is a written table;
    the driver sees two numbers a step. Self loops, repeated edges, edges with a
    null end and an empty input are fine (null ends are dropped).
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not state[0]:
            break
        if before == state:
            break
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True)
        following = _star(large, larger=False)
        discard(large)
        discard(current)
        current = following
    # every edge now joins a node to the smallest of its component
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """One step, as a written table. larger: over all neighbours, move the larger ones; otherwise over
    the smaller neighbours and the node itself (edges already point to the smaller)."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = directed.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
    if larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
    return materialize(moved.where("u <> v").distinct(), "star")
