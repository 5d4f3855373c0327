"""Connected components by repeated least-neighbour contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import forget, settled


def undirected_components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component; links are (src, dst).

    Every round joins each node to its least neighbour's root and halves paths,
    so the number of rounds is logarithmic in practice."""
    both = settled(links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    root = settled(both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")))
    new = None
    while True:
        # the least root around each root's members, then one jump along it
        near = both.join(root.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        hook = root.join(near, "node").groupBy("root").agg(F.min(F.least("root", "near")).alias("to"))
        jump = hook.select("root", F.col("to").alias("mid")).join(hook.select(F.col("root").alias("mid"), F.col("to").alias("far")), "mid").select("root", "far")
        old, new = new, settled(root.join(jump, "root").select("node", F.col("far").alias("root"), F.col("root").alias("was")))
        forget(old)
        root = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return root
