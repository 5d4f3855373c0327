"""Cutting lineage inside driver loops through the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that has none
    gets a temporary one."""
    root = spark.conf.get(KEY, None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {KEY} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(KEY, root)
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written as Parquet to the shared folder, where any
    executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_path = path
    return back


def forget(*frames: DataFrame | None) -> None:
    """Deletes settled frames that nothing reads any more."""
    for path in {getattr(f, "_settled_path", None) for f in frames} - {None}:
        spark = next(f for f in frames if f is not None).sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
