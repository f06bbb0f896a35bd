"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate followed by an equi-join; no neighbour list is ever
collected, so a hub with many edges costs rows, not one task's memory.  Each
step's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.storage import cut


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are absent.

    Self-loops and null ends are ignored, repeated edges do no harm.  Raises if
    the labels have not settled after ``max_rounds``, which a graph of a
    diameter under 2**60 doesn't reach.
    """
    e = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo"))
    e = cut(e.where("hi is not null and lo is not null and hi <> lo").distinct(), "cc")
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u goes to the smallest neighbour of u (or u itself)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small-star: u and its smaller neighbours go to the smallest of them
        large = cut(large, "cc")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        e = cut(small.where("hi <> lo").distinct(), "cc")
        after = _state(e)
        if after == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
