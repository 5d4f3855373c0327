"""Positions in an order, without a task that sorts a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled


def rank_in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with the 1-based position of each row in its group.

    Rows are sorted in ranges of (group, order), so a group of any size is spread
    over tasks.  A position is that in the range, plus the group's rows in the
    ranges before: counts, at most one for each group and range that meet.  Rows
    that tie in the whole order share no fixed positions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *(F.asc(c) for c in group), *order).withColumn("__range", F.spark_partition_id())
    dealt = settled(dealt)
    sizes = dealt.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"__g{k}") for k, c in enumerate(group)]
    before = sizes.select(F.col("__range").alias("__r"), *keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order))
    same = F.col("__range") == F.col("__r")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    ranked = dealt.withColumn("__own", own).join(before, same)
    return ranked.select(*df.columns, (F.col("__own") + F.col("__before")).cast("long").alias(name))
