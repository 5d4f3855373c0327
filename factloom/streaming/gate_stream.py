"""A gate over a stream of changed files.  The batch design has no stream; this
is an addition: each micro-batch of (rel, text) rows is gated on its own and its
findings are appended, so a replayed batch overwrites its own output only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.audit import gate


def gate_stream(files: DataFrame, out: str, checkpoint: str, baseline: DataFrame | None = None) -> StreamingQuery:
    def one(batch: DataFrame, number: int) -> None:
        rows = gate(batch, batch.select("rel"), baseline)
        rows.drop("lines").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
