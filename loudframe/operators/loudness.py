"""Track, album and library loudness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe.functions import levels as L
from loudframe.operators.histogram import loudness_bins, merge_histograms, percentile_loudness
from loudframe.session import durable


def _with_gain(levels: DataFrame) -> DataFrame:
    gain = L.suggest_gain(F.col("loudness_db"))
    return levels.withColumn("gain_db", gain).withColumn("gain_steps", L.db_to_steps(gain))


def track_levels(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loudness, gain and peak per key from merged histogram rows."""
    return _with_gain(percentile_loudness(hist, keys)).drop("bin")


def track_loudness(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loudness, recommended gain, steps and peak per track from window sums."""
    return track_levels(loudness_bins(windows, keys, keep_outside=True), keys)


def album_loudness(hist: DataFrame, album: Sequence[str]) -> DataFrame:
    """A10: merged-histogram loudness and peak per album; longer tracks weigh more."""
    levels = track_levels(merge_histograms(hist, album), album)
    return levels.select(
        *album,
        "windows",
        F.col("loudness_db").alias("album_loudness_db"),
        F.col("gain_db").alias("album_gain_db"),
        F.col("gain_steps").alias("album_gain_steps"),
        F.col("peak").alias("album_peak"),
    )


def level_tables(windows: DataFrame, keys: Sequence[str], album: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Track levels and album levels from window sums, reading the signal once.

    Both sides of a later join of the two would otherwise run the whole pipeline. The
    histogram, at most 12,000 small rows per track, is stored in between.
    """
    hist = durable(loudness_bins(windows, keys, keep_outside=True))
    return track_levels(hist, keys), album_loudness(hist, album)


def loudness_rollup(hist: DataFrame, album: str = "album", track: str = "track") -> DataFrame:
    """Track, album and library levels in one pass over the histogram rows."""
    counted = hist.groupingSets(
        [[F.col(album), F.col(track), F.col("bin")], [F.col(album), F.col("bin")], [F.col("bin")]],
        F.col(album), F.col(track), F.col("bin"),
    ).agg(
        F.grouping_id().cast("int").alias("gid"),
        F.sum("cnt").alias("cnt"),
        F.max("peak").alias("peak"),
    )
    level = F.when(F.col("gid") == 0, "track").when(F.col("gid") == 2, "album").otherwise("library")
    named = counted.withColumn("level", level).drop("gid")
    return track_levels(named, ["level", album, track])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL is a key like any other; each key column comes out once."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = left.join(other, met, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":  # a row without a left side has its keys on the right; where both exist they agree
        joined = joined.withColumns({k: F.coalesce(k, f"__r_{k}") for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])


def join_album(tracks: DataFrame, albums: DataFrame, album: Sequence[str]) -> DataFrame:
    """Every track with the levels of its album.

    Adaptive execution broadcasts the album side only when its real size is small, and
    splits the partition of an album that holds a large part of all tracks otherwise.
    """
    return join_null_safe(tracks, albums, list(album))


def fail_fast_albums(tracks: DataFrame, albums: DataFrame, album: Sequence[str],
                     mode: str = "failfast") -> DataFrame:
    """An album with a failed track has no result; ``permissive`` keeps what could be measured."""
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode must be 'failfast' or 'permissive'")
    state = tracks.groupBy(*album).agg(
        F.count(F.lit(1)).alias("tracks"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.min("error").alias("error"),
    )
    joined = join_null_safe(state, albums, list(album))
    if mode == "permissive":
        return joined
    values = [c for c in albums.columns if c not in album]
    bad = F.col("failed") > 0
    return joined.select(
        *album, "tracks", "failed", "error", *[F.when(~bad, F.col(c)).alias(c) for c in values]
    )
