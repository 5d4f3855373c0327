"""Connected components by alternating star contractions.

Each round rewrites every edge towards the smallest neighbour; a logarithmic
number of rounds is typical and no adjacency list is ever gathered.  Every round
is written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v).  Hang neighbours of each node on its smallest neighbour."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(low, "u")
    if large:
        kept = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return kept.where("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root): for every node of an edge the smallest node it reaches."""
    spot = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, mark = scratch.table(spot, "edges"), None
    for _ in range(most):
        new = scratch.table(_star(_star(now, True), False), "stars")
        said = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if said == mark:
            break
        mark = said
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
