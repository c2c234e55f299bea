"""Masking of a stream: the batch operators over each micro-batch, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import mask


def masked(stream: DataFrame, pii: Sequence[str] = (), phi: Sequence[str] = ()) -> DataFrame:
    """Masking needs no state, so it is the same projection on a stream as on a table."""
    return mask(stream, pii, phi)


def masked_sink(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Applies a batch operator to each micro-batch and writes it under its batch number, so that a batch that runs
    again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
