"""Streams of receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_receipts(stream: DataFrame, keys: list[str], received_at: str, delay: str) -> DataFrame:
    """Each key once: retries within ``delay`` of event time are dropped, and the state of older keys with them."""
    return stream.withWatermark(received_at, delay).dropDuplicatesWithinWatermark(keys)


def equal_time_groups(stream: DataFrame, keys: list[str], available_at: str, row_id: str, delay: str) -> DataFrame:
    """keys, available_at, rows, first_id, last_id: what became available at one instant, given out once and whole.

    A group is given out when the watermark has passed it, so never before its time; ``delay`` bounds how late its rows may come."""
    groups = stream.withWatermark(available_at, delay).groupBy(*keys, available_at)
    return groups.agg(F.count("*").alias("rows"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))


def keep_batches(path: str):
    """A foreachBatch writer: a batch that is run again after a failure replaces its own folder and no other."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
