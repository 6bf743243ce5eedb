"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum, which Spark aggregates before the shuffle, and an equi-join with these minima, which
are written first, so that adaptive execution can split hot keys. Each round is written to the shared folder, so that
neither lineage nor lost executors matter; what a round no longer needs is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b, both directions taken for the large star, a's smaller neighbours for the small star. Removes edges."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    linked = both.join(least, "a")
    if large:
        moved = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    moved = written(moved.where("a > b").distinct(), "edges")
    discard(least)
    discard(edges)
    return moved


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of each node of edges a, b other than those smallest."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = _star(_star(now, large=True), large=False)
        found = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if found == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = found
