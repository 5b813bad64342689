"""Mean square per 50 ms window, peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L


def window_sums(samples: DataFrame, keys: Sequence[str], position: Column, per_window: Column | int,
                left: Column, right: Column | None = None, peak: Column | None = None) -> DataFrame:
    """Sum of squares, sample count and peak per tumbling window.

    A mono sample (no right value) counts for both channels. Sums are kept so that parts of
    one window coming from different places can still be added up.
    """
    per_window = F.lit(per_window) if isinstance(per_window, int) else per_window
    right = left if right is None else F.coalesce(right, left)
    peak = F.greatest(F.abs(left), F.abs(right)) if peak is None else peak
    return (
        samples.withColumn("window_no", L.int_div(position, per_window))
        .groupBy(*keys, "window_no")
        .agg(
            F.sum(left * left + right * right).alias("sum_squares"),
            F.count(F.lit(1)).alias("samples"),
            F.max(peak).alias("peak"),
        )
    )


def merge_window_sums(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up partial windows."""
    return parts.groupBy(*keys, "window_no").agg(
        F.sum("sum_squares").alias("sum_squares"), F.sum("samples").alias("samples"), F.max("peak").alias("peak")
    )


def mean_square(sum_squares: Column, samples: Column) -> Column:
    """Average of both channels; a short last window divides by its own length."""
    return sum_squares / samples * F.lit(0.5)


def window_mean_square(samples: DataFrame, keys: Sequence[str], position: Column, per_window: Column | int,
                       left: Column, right: Column | None = None) -> DataFrame:
    """A3: one row per window with its mean square."""
    sums = window_sums(samples, keys, position, per_window, left, right)
    return sums.select(
        *keys, "window_no", "samples", mean_square(F.col("sum_squares"), F.col("samples")).alias("mean_square")
    )


def packet_window_sums(packets: DataFrame, keys: Sequence[str] = ("album", "track")) -> DataFrame:
    """A3 on packets that carry ``first_sample``: 50 ms window sums at each packet's own rate.

    A packet is cut at the window borders and summed inside its row, so as many rows as windows
    it touches are shuffled, not one per sample. A packet without samples touches none.
    """
    per_window = L.window_samples(F.col("sample_rate"))
    size = F.size("left")
    usable = packets.where((size > 0) & (per_window > 0))
    first, last = L.int_div(F.col("first_sample"), per_window), L.int_div(F.col("first_sample") + size - 1, per_window)
    scaled = usable.select(
        *keys, "first_sample", per_window.cast("bigint").alias("__per"), size.cast("bigint").alias("__size"),
        L.scale_samples(F.col("left"), F.col("format")).alias("__left"), L.scale_samples(F.col("right"), F.col("format")).alias("__right"),
        F.sequence(first, last).alias("__windows"))

    def part(window: Column) -> Column:
        start = F.greatest(window * F.col("__per") - F.col("first_sample"), F.lit(0).cast("bigint"))
        stop = F.least((window + 1) * F.col("__per") - F.col("first_sample"), F.col("__size"))
        cut = lambda side: F.slice(side, (start + 1).cast("int"), (stop - start).cast("int"))
        energy = lambda side: F.aggregate(cut(side), F.lit(0.0), lambda a, x: a + x * x)
        top = lambda side: F.aggregate(cut(side), F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
        left, right = F.col("__left"), F.col("__right")
        # A mono packet counts for both channels.
        return F.struct(window.alias("window_no"), (energy(left) + F.when(right.isNull(), energy(left)).otherwise(energy(right))).alias("sum_squares"),
                        (stop - start).alias("samples"), F.greatest(top(left), F.when(right.isNull(), 0.0).otherwise(top(right))).alias("peak"))

    parts = scaled.select(*keys, F.explode(F.transform("__windows", part)).alias("w")).select(*keys, "w.*")
    return merge_window_sums(parts, keys)


def explode_packets(packets: DataFrame, keys: Sequence[str] = ("album", "track")) -> DataFrame:
    """One row per sample of packets that carry ``first_sample``, scaled to the 16-bit range."""
    scaled = packets.select(
        *keys,
        "sample_rate",
        "first_sample",
        F.arrays_zip(
            L.scale_samples(F.col("left"), F.col("format")).alias("left"),
            L.scale_samples(F.coalesce("right", "left"), F.col("format")).alias("right"),
        ).alias("pairs"),
    )
    return scaled.select(*keys, "sample_rate", "first_sample", F.posexplode("pairs").alias("pos", "pair")).select(
        *keys,
        "sample_rate",
        (F.col("first_sample") + F.col("pos")).alias("n"),
        F.col("pair.left").alias("left"),
        F.col("pair.right").alias("right"),
    )


def packet_peak(packets: DataFrame, keys: Sequence[str] = ("album", "track")) -> DataFrame:
    """A5: largest normalised magnitude over the first two channels, 0 for empty packets."""
    scale = L.sample_scale(F.col("format")) / F.lit(C.PCM_SCALE)
    both = F.greatest(L.array_peak(F.col("left")), L.array_peak(F.col("right")))
    return packets.groupBy(*keys).agg(F.coalesce(F.max(both * scale), F.lit(0.0)).alias("peak"))


def peak_all_channels(packets: DataFrame, keys: Sequence[str], channels: str = "channels",
                      sample_format: str = "format") -> DataFrame:
    """Largest normalised magnitude over every channel, also in 16-bit units."""
    scale = L.sample_scale(F.col(sample_format)) / F.lit(C.PCM_SCALE)
    found = packets.groupBy(*keys).agg(
        F.coalesce(F.max(L.array_peak(F.flatten(channels)) * scale), F.lit(0.0)).alias("peak")
    )
    return found.withColumn("peak_pcm", F.col("peak") * F.lit(C.PCM_SCALE))
