"""Keeps the latest state per key from a stream: newer generations supersede older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def latest_state(stream: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """A streaming aggregation: the columns of the row with the greatest order per key."""
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def write_latest(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes every batch's changed keys to path/batch=<id>; a batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest_state(stream, keys, order, columns).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
