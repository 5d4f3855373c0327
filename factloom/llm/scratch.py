"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; any executor
(or a restarted one) can read it again.  Where that setting is missing, a local
session, as in tests, gets a temporary folder; a cluster gets an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


class Scratch:
    """Named Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._serial = 0
        self._tables: list[DataFrame] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._serial += 1
        path = f"{self.base}/{self._serial:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        self._tables.append(back)
        return back

    def only(self, kept: DataFrame) -> None:
        """Drops all tables but one, and the shuffles of the steps that made it."""
        self.drop(*(t for t in self._tables if t is not kept))
        self._tables = [kept]
        self.release()

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps that are over: it does so
        once their plans are garbage, which a driver with little to do is slow to
        find out."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                jvm = self.spark._jvm
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def bits_for(keys: int, most: int, least: int = 15) -> int:
    """Bits for a filter in which some 16 bits fall to a key, up to ``most``."""
    return max(least, min(most, (16 * max(keys, 1)).bit_length()))
