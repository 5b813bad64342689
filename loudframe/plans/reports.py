"""Batch reports: one row per file, and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import gains as G
from loudframe.functions import levels as L
from loudframe.functions import tags as T
from loudframe.functions.report import status_of
from loudframe.operators.loudness import join_album


def batch_summary(report: DataFrame, dry_run: bool = False) -> DataFrame:
    """All files, successes and failures; every other status counts in neither."""
    return report.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.lit(True if dry_run else None).cast("boolean").alias("dry_run"),
    )


def _apply_rows(rows: DataFrame, *, prevent: bool, ignore: bool, wrap: bool, compat: bool, dry_run: bool) -> DataFrame:
    """Result rows from ``file, kind, loudness_db, gain_db, peak, requested_steps, frames, error``."""
    limited = G.limit_by_peak(F.col("requested_steps"), F.col("gain_db"), F.col("peak"),
                              prevent=prevent, ignore=ignore, wrap=wrap, compat=compat)
    rows = rows.withColumn("__l", limited)
    skipped = F.col("requested_steps") == 0
    tags_only = ~skipped & (F.col("kind") != "mp3") & F.lit(not dry_run)
    steps = F.when(skipped, F.lit(0)).when(tags_only, L.db_to_steps(F.col("gain_db"))).otherwise(F.col("__l.steps"))
    db = F.when(tags_only, F.col("gain_db")).otherwise(L.steps_to_db(steps))
    failed = F.col("error").isNotNull()
    return rows.select(
        *[c for c in rows.columns if c in ("album", "track")],
        "file",
        status_of(error=F.col("error"), steps=F.col("requested_steps"), dry_run=dry_run).alias("status"),
        F.when(~failed & ~skipped & ~tags_only & F.lit(not dry_run) & (steps != 0), F.col("frames")).alias("frames"),
        F.when(~failed, F.col("loudness_db")).alias("loudness_db"),
        F.when(~failed, F.col("peak")).alias("peak"),
        F.when(~failed, steps.cast("int")).alias("gain_applied_steps"),
        F.when(~failed, db).alias("gain_applied_db"),
        F.when(~failed & ~skipped, F.col("__l.warning")).alias("warning"),
        F.col("error"),
        F.when(F.lit(dry_run) & ~failed & ~skipped, F.lit(True)).alias("dry_run"),
    )


def track_gain_report(tracks: DataFrame, modifier_steps: int = 0, modifier_db: float = 0.0, *, prevent: bool = False,
                      ignore: bool = False, wrap: bool = False, compat: bool = False, dry_run: bool = False) -> DataFrame:
    """Apply each track's own gain.

    ``tracks`` has file, kind, loudness_db, gain_db, peak, frames, error. Files that are not
    mp3 only get level tags, so their row shows the exact gain instead of whole steps.
    """
    shifted = L.retarget_db(F.col("gain_db"), modifier_db)
    rows = tracks.withColumn("requested_steps", L.retarget_steps(shifted, modifier_steps))
    return _apply_rows(rows, prevent=prevent, ignore=ignore, wrap=wrap, compat=compat, dry_run=dry_run)


def album_gain_report(tracks: DataFrame, albums: DataFrame, album: Sequence[str] = ("album",), modifier_steps: int = 0,
                      *, prevent: bool = False, ignore: bool = False, wrap: bool = False, compat: bool = False,
                      dry_run: bool = False) -> DataFrame:
    """Apply the album's gain to each of its tracks; a failed album fails all of its rows."""
    rows = join_album(tracks, albums, album)
    failed = F.coalesce(F.col("error"), F.when(F.col("album_gain_db").isNull(), F.lit("Failed to analyze album")))
    rows = rows.withColumn("error", failed).withColumn(
        "requested_steps", L.retarget_steps(F.col("album_gain_db"), modifier_steps)
    )
    return _apply_rows(rows, prevent=prevent, ignore=ignore, wrap=wrap, compat=compat, dry_run=dry_run)


def max_amplitude_report(measures: DataFrame) -> DataFrame:
    """Peak in 16-bit units, headroom, gain range and the clip warning.

    ``measures`` has file, kind, peak, min_gain, max_gain, error.
    """
    ok = F.col("error").isNull()
    text = "peak may be clipped - actual value could be higher"
    return measures.select(
        "file",
        F.when(~ok, "error").alias("status"),
        F.when(ok, F.col("peak") * F.lit(C.PCM_SCALE)).alias("max_amplitude"),
        F.when(ok, L.peak_headroom_db(F.col("peak"))).alias("headroom_db"),
        F.when(ok, F.col("max_gain")).alias("max_gain"),
        F.when(ok, F.col("min_gain")).alias("min_gain"),
        F.when(ok & L.may_be_clipped(F.col("kind"), F.col("peak")), text).alias("warning"),
        "error",
    )


def info_report(files: DataFrame, stats: DataFrame, path: str = "path") -> DataFrame:
    """Frame statistics per mp3 file, a placeholder for mp4 files, an error without frames.

    ``files`` has the path and ``kind``; ``stats`` comes from ``frame_stats``.
    """
    joined = files.join(stats, path, "left")
    info = F.col("kind") == "mp4"
    error = F.when(~info & F.col("frames").isNull(), F.lit("No valid MP3 frames found"))
    shown = ["frames", "mpeg_version", "channel_mode", "min_gain", "max_gain", "avg_gain", "headroom_steps", "headroom_db"]
    return joined.select(
        F.col(path).alias("file"),
        F.when(error.isNotNull(), "error").when(info, "info").alias("status"),
        *[F.when(~info, F.col(c)).alias(c) for c in shown if c in stats.columns],
        error.alias("error"),
    )


def tag_report(joined: DataFrame, keys: Sequence[str] = C.REPORT_KEYS) -> DataFrame:
    """Known tags as columns with '-' for missing ones, and the status of each file."""
    return joined.select(
        F.col("path").alias("file"),
        F.when(F.col("has_tag"), "success").otherwise("no_tag").alias("status"),
        *[F.coalesce(F.col(k.lower()), F.lit("-")).alias(k.lower()) for k in keys],
    )


def loudness_table(tracks: DataFrame, albums: DataFrame, album: Sequence[str] = ("album",),
                   target_db: float = C.REFERENCE_DB) -> DataFrame:
    """The grid of volumes, gains and clip flags per track and album."""
    rows = join_album(tracks, albums, album)
    track_gain = L.target_gain(F.col("gain_db"), target_db)
    album_gain = L.target_gain(F.col("album_gain_db"), target_db)
    ok = F.col("error").isNull() if "error" in tracks.columns else F.lit(True)
    return rows.select(
        *album,
        "track",
        F.when(ok, L.display_volume(F.col("gain_db"))).alias("volume"),
        F.when(ok, L.is_clipping(F.col("peak"))).alias("clipping"),
        F.when(ok, track_gain).alias("track_gain"),
        F.when(ok, L.would_clip(F.col("peak"), track_gain)).alias("track_clip"),
        L.display_volume(F.col("album_gain_db")).alias("album_volume"),
        album_gain.alias("album_gain"),
        L.would_clip(F.col("album_peak"), album_gain).alias("album_clip"),
        F.when(ok, "analyzed").otherwise("error").alias("status"),
    )


def level_tags(tracks: DataFrame, albums: DataFrame | None = None, album: Sequence[str] = ("album",)) -> DataFrame:
    """Level tag lists (path, items) for files that are tagged instead of patched."""
    rows = tracks if albums is None else join_album(tracks, albums, album)
    pair = (None, None) if albums is None else (F.col("album_gain_db"), F.col("album_peak"))
    items = T.level_tags(F.col("gain_db"), F.col("peak"), *pair)
    return rows.select(F.col("file").alias("path"), items.alias("items"))
