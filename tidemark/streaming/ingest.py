"""Streaming ingestion of mutations: each micro-batch becomes tables; state queries with watermark-free latest-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import latest_by_agg


def latest_stream(mutations: DataFrame) -> DataFrame:
    """The newest entry of each key so far (update or complete mode). Order is by seq, not by arrival, so late mutations
    never win over newer ones."""
    return mutations.groupBy("key").agg(F.max_by(F.struct("val", "tombstone"), "seq").alias("last"), F.max("seq").alias("seq")).select("key", "last.val", "last.tombstone", "seq")


def append_batches(mutations: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each micro-batch, newest entry per key, below path/batch=<id>; a repeated batch
    overwrites its own folder, so that restarts leave no doubles."""

    def store(batch: DataFrame, number: int) -> None:
        latest_by_agg(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mutations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()
