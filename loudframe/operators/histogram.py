"""Loudness histograms: sparse rows (keys, bin, cnt) that merge by addition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L
from loudframe.operators.windows import mean_square


def loudness_bins(windows: DataFrame, keys: Sequence[str], keep_outside: bool = False) -> DataFrame:
    """A4: windows per level bin.

    ``windows`` has ``sum_squares``, ``samples`` and ``peak``. Levels outside the histogram are
    dropped; with ``keep_outside`` they stay as rows with a NULL bin, so that a track without
    a single countable window is still present.
    """
    binned = windows.withColumn("bin", L.level_bin(mean_square(F.col("sum_squares"), F.col("samples"))))
    if not keep_outside:
        binned = binned.where(F.col("bin").isNotNull())
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if "peak" in windows.columns:
        aggs.append(F.max("peak").alias("peak"))
    return binned.groupBy(*keys, "bin").agg(*aggs)


def merge_histograms(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the counts of many histograms."""
    aggs = [F.sum("cnt").alias("cnt")]
    if "peak" in hist.columns:
        aggs.append(F.max("peak").alias("peak"))
    return hist.groupBy(*keys, "bin").agg(*aggs)


def reverse_cumulative(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows at or above each bin, and the total. A key has at most 12,000 rows."""
    counted = F.when(F.col("bin").isNotNull(), F.col("cnt")).otherwise(F.lit(0))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    down = whole.orderBy(F.col("bin").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    full = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hist.select("*", F.sum(counted).over(down).alias("cum"), F.sum(counted).over(full).alias("total"))


def percentile_bin(hist: DataFrame, keys: Sequence[str], percentile: float = C.PERCENTILE) -> DataFrame:
    """Highest bin at which the share of louder-or-equal windows reaches the top percentile.

    Expects merged rows, one per key and bin. The rank rule is ``ceil(total * (1 - p))`` in doubles.
    """
    need = F.ceil(F.col("total").cast("double") * (F.lit(1.0) - F.lit(float(percentile))))
    reached = F.col("bin").isNotNull() & (F.col("cum") >= need)
    aggs = [F.max(F.when(reached, F.col("bin"))).alias("bin"), F.max("total").alias("windows")]
    if "peak" in hist.columns:
        aggs.append(F.max("peak").alias("peak"))
    return reverse_cumulative(hist, keys).groupBy(*keys).agg(*aggs)


def percentile_loudness(hist: DataFrame, keys: Sequence[str], percentile: float = C.PERCENTILE) -> DataFrame:
    """Loudness in dB per key; -20.0 when nothing was counted."""
    found = percentile_bin(hist, keys, percentile)
    level = F.coalesce(L.bin_db(F.col("bin")), F.lit(C.EMPTY_LOUDNESS_DB))
    return found.withColumn("loudness_db", level)


def loudest_windows(windows: DataFrame, keys: Sequence[str], percentile: float = C.PERCENTILE,
                    top: int | None = None, order: Sequence[str] = ("window_no",)) -> DataFrame:
    """O2: windows at or above the percentile bin of their key, optionally the ``top`` loudest of all."""
    binned = windows.withColumn("bin", L.level_bin(mean_square(F.col("sum_squares"), F.col("samples"))))
    hist = binned.where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    limits = percentile_bin(hist, keys, percentile).select(*keys, F.col("bin").alias("limit_bin"))
    loud = binned.join(limits, list(keys)).where(F.col("bin") >= F.col("limit_bin"))
    if top is not None:
        loud = loud.orderBy(F.col("bin").desc(), *keys, *order).limit(top)
    return loud
