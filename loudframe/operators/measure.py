"""From packets to one row per track: its level, or the reason why it has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L
from loudframe.operators.filtering import DEFAULT_CHUNK, filter_window_sums, packet_size, rate_error
from loudframe.operators.histogram import loudness_bins
from loudframe.operators.loudness import album_loudness, join_null_safe, track_levels
from loudframe.session import durable

NO_TRACK_ERROR = "No audio track found"
NO_RATE_ERROR = "Unknown sample rate"


def track_checks(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per track: keys, sample_rate, packets, samples and the error that forbids measuring it.

    Reads no sample values. Packets that could not be decoded (no left channel) have no samples and
    are no error, as long as the track's rate is known.
    """
    rate, least, most = F.col("sample_rate"), F.col("__least"), F.col("__most")
    found = packets.groupBy(*keys).agg(
        F.min(rate).alias("__least"), F.max(rate).alias("__most"), F.count_if(rate.isNull()).alias("__unknown"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.when(F.col("left").isNotNull(), packet_size(packets)).otherwise(0)).alias("samples"),
    )
    changes = F.format_string("Sample rate changes inside the track: %d to %d Hz", least, most)
    error = F.when(F.col("__unknown") > 0, NO_RATE_ERROR).when(least != most, changes).otherwise(rate_error(least))
    return found.select(*keys, F.when(least == most, least).cast("int").alias("sample_rate"), "packets", "samples", error.alias("error"))


def _levels_or_error(checks: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = join_null_safe(checks, levels, keys)
    fine = F.col("error").isNull()
    level = F.coalesce("loudness_db", F.lit(C.EMPTY_LOUDNESS_DB))
    gain = L.suggest_gain(level)

    def shown(value: Column, name: str) -> Column:
        return F.when(fine, value).alias(name)

    return rows.select(
        *keys, "sample_rate", "packets", "samples",
        shown(F.coalesce("windows", F.lit(0).cast("bigint")), "windows"), shown(level, "loudness_db"), shown(gain, "gain_db"),
        shown(L.db_to_steps(gain), "gain_steps"), shown(F.coalesce("peak", F.lit(0.0)), "peak"), "error",
    )


def measure(packets: DataFrame, keys: Sequence[str] = ("album", "track"), album: Sequence[str] = ("album",),
            catalog: DataFrame | None = None, mode: str = "failfast", chunk: int = DEFAULT_CHUNK) -> tuple[DataFrame, DataFrame]:
    """Track rows and album rows from packets, every track and album exactly once.

    A track has its level (``loudness_db``, ``gain_db``, ``gain_steps``, ``peak``) or an ``error``: an
    unknown or unsupported sample rate, a rate that changes inside the track, or, with a
    ``catalog`` of expected keys, no packets at all. A track without samples has the level of an
    empty histogram. NULL keys are keys. Albums have ``tracks``, ``failed``, the first ``error`` and their
    level: none with a failed track (``failfast``), or that of the tracks that could be measured
    (``permissive``).

    Samples are read and shuffled once, for the filter; the checks read rates and sizes only, and
    everything after the stored histogram is at most 12,000 small rows per track.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    keys, album = list(keys), list(album)
    checks = track_checks(packets, keys)
    if catalog is not None:
        both = join_null_safe(catalog.select(*keys).distinct(), checks.withColumn("__seen", F.lit(True)), keys, "full")
        missing = F.when(F.col("__seen").isNull(), NO_TRACK_ERROR).otherwise(F.col("error"))
        checks = both.withColumns({"error": missing, "packets": F.coalesce("packets", F.lit(0)), "samples": F.coalesce("samples", F.lit(0))}).drop("__seen")
    checks = durable(checks)
    hist = durable(loudness_bins(filter_window_sums(packets, keys, chunk), keys, keep_outside=True))
    # A track whose rate changes went through the filter like the others; its windows don't count.
    good = join_null_safe(hist, checks.where("error IS NULL").select(*keys), keys, "left_semi")
    tracks = _levels_or_error(checks, track_levels(good, keys), keys)
    state = checks.groupBy(*album).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("error").alias("error"))
    rows = join_null_safe(state, album_loudness(good, album), album)
    level = F.coalesce("album_loudness_db", F.lit(C.EMPTY_LOUDNESS_DB))
    gain = L.suggest_gain(level)
    fine = F.col("failed") == 0 if mode == "failfast" else F.col("failed") < F.col("tracks")
    values = {"windows": F.coalesce("windows", F.lit(0).cast("bigint")), "album_loudness_db": level, "album_gain_db": gain,
              "album_gain_steps": L.db_to_steps(gain), "album_peak": F.coalesce("album_peak", F.lit(0.0))}
    return tracks, rows.select(*album, "tracks", "failed", "error", *[F.when(fine, v).alias(n) for n, v in values.items()])
