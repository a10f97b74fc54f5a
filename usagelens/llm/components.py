"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest v of its u. The join is many-to-one, so that a hot u can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


#: Edges in a file, about.
PART_ROWS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of integers to (node, root): the smallest node reachable, for each node with an edge.

    Runs until nothing changes; every round writes its edges to the shared folder. Stars are kept, never pairs.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = cut_lineage(now, "components")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        near = _nearest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # a round has no more edges than twice those of the one before: no more files than these need
        now = cut_lineage(small.coalesce(max(1, -(-2 * state[0] // PART_ROWS))), "components")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
