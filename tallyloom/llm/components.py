"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and an equi join
whose other side has one row per node, which Spark splits when a hub is hot.
Nothing is gathered in one place; each step's edges are written to the shared
folder, so its plan is short and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, mark, sweep


def _to_minimum(links: DataFrame, also_self: bool) -> DataFrame:
    """links(u, v): joins each v to the least of u's neighbours (and u itself if ``also_self``)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if also_self:
        least = least.select("u", F.least("u", "m").alias("m"))
    # Written first: both sides are then exchanged for the join itself, and only such a join is split where a hub is hot.
    return links.join(keep(least), "u")


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long); root is the component's least node.

    Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    e = keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_steps):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        since = mark()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, True).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = keep(large)
        small = _to_minimum(large, False)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        after = keep(small)
        sweep(e.sparkSession, since)
        drop(e)
        e = after
    else:
        raise RuntimeError(f"components have not settled in {max_steps} steps")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
