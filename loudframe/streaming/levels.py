"""ST1: event-time window levels and a histogram table that grows by merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe.operators.histogram import loudness_bins, merge_histograms
from loudframe.streaming.store import MergedTable


def stream_windows(stream: DataFrame, keys: Sequence[str], ts: str, left: Column, right: Column | None = None,
                   width: str = "50 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Window sums by event time; a window is final once the watermark has passed it."""
    right = left if right is None else F.coalesce(right, left)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, width).alias("window"))
        .agg(
            F.sum(left * left + right * right).alias("sum_squares"),
            F.count(F.lit(1)).alias("samples"),
            F.max(F.greatest(F.abs(left), F.abs(right))).alias("peak"),
        )
    )


def histogram_table(spark: SparkSession, keys: Sequence[str], target: str, every: int = 8) -> MergedTable:
    """The stored histogram: batches are added up."""
    return MergedTable(spark, target, lambda rows: merge_histograms(rows, keys), every)


def write_histogram(windows: DataFrame, keys: Sequence[str], target: str, checkpoint: str, every: int = 8):
    """Add the final windows of each batch to a histogram table.

    A repeated batch does not count twice, and reading (``read_histogram``) opens one snapshot and
    ``every`` deltas at most.
    """
    table = histogram_table(windows.sparkSession, keys, target, every)

    def add(batch: DataFrame, batch_id: int) -> None:
        table.add(loudness_bins(batch, keys), batch_id, writer=checkpoint)

    return (
        windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(add).trigger(availableNow=True).start()
    )


def read_histogram(spark: SparkSession, keys: Sequence[str], target: str) -> DataFrame:
    return histogram_table(spark, keys, target).read()
