"""Applying track or album gains: one request table, and what follows from it.

``gain_requests`` decides for every file once; report, patches, tag rows and ledger entries are views
of the stored decision, so they cannot disagree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loudframe.functions import gains as G
from loudframe.functions import levels as L
from loudframe.functions import tags as T
from loudframe.functions.report import status_of
from loudframe.operators.frames import NO_FRAMES
from loudframe.operators.loudness import join_null_safe
from loudframe.plans import gain_plan as GP
from loudframe.session import durable

NO_ALBUM_ERROR = "Failed to analyze album"
UNDO_KEY, MINMAX_KEY = "MP3GAIN_UNDO", "MP3GAIN_MINMAX"


def gain_requests(tracks: DataFrame, stats: DataFrame, albums: DataFrame | None = None, album: Sequence[str] = ("album",), *,
                  modifier_steps: int = 0, modifier_db: float = 0.0, prevent: bool = False, ignore: bool = False,
                  wrap: bool = False, compat: bool = False, dry_run: bool = False) -> DataFrame:
    """The decision for every file, stored: what was asked, what is done, and why not.

    ``tracks`` has ``path``, ``kind``, the levels of ``measure`` and ``error``; ``stats`` the frame statistics per
    path. With ``albums`` the album's gain is applied, and a failed album fails all of its files.
    Files that are not mp3 are only tagged. An mp3 file without frames is an error.
    """
    rows = join_null_safe(tracks, stats.select("path", "frames", "min_gain", "max_gain"), ["path"])
    error = F.col("error")
    if albums is None:
        gain = F.col("gain_db")
        rows = rows.withColumns({"album_gain_db": F.lit(None).cast("double"), "album_peak": F.lit(None).cast("double")})
    else:
        album = list(album)
        levels = albums.select(*album, "album_gain_db", "album_peak", F.lit(True).alias("__known"))
        rows = join_null_safe(rows, levels, album)
        error = F.coalesce(error, F.when(F.col("album_gain_db").isNull(), NO_ALBUM_ERROR))
        gain = F.col("album_gain_db")
    # Without a level there is nothing to round: steps of a missing gain would saturate.
    wanted = F.when(gain.isNotNull(), L.retarget_steps(L.retarget_db(gain, modifier_db), modifier_steps))
    mp3 = F.col("kind") == "mp3"
    error = F.coalesce(error, F.when(mp3 & F.col("frames").isNull() & (wanted != 0), NO_FRAMES))
    limited = G.limit_by_peak(wanted, F.col("gain_db"), F.col("peak"), prevent=prevent, ignore=ignore, wrap=wrap, compat=compat)
    rows = rows.withColumn("error", error).withColumn("__asked", wanted).withColumn("__l", limited)
    fine, tagged = F.col("error").isNull(), ~mp3 & F.lit(not dry_run)
    moved = fine & (F.col("__asked") != 0)
    steps = F.when(~moved, 0).when(tagged, L.db_to_steps(F.col("gain_db"))).otherwise(F.col("__l.steps"))
    keys = [c for c in tracks.columns if c in ("album", "track")]
    return durable(rows.select(
        *keys, "path", "kind",
        status_of(error=F.col("error"), steps=F.col("__asked"), dry_run=dry_run).alias("status"),
        F.when(fine, F.col("__asked")).cast("int").alias("requested_steps"),
        F.when(fine, steps).cast("int").alias("steps"),
        F.when(fine, F.when(moved & tagged, F.col("gain_db")).otherwise(L.steps_to_db(steps))).alias("applied_db"),
        *[F.when(fine, F.col(c)).alias(c) for c in ("loudness_db", "gain_db", "peak", "album_gain_db", "album_peak")],
        F.when(moved & mp3, F.col("frames")).alias("frames"), F.when(mp3, F.col("min_gain")).alias("min_gain"),
        F.when(mp3, F.col("max_gain")).alias("max_gain"),
        F.when(moved, F.col("__l.warning")).alias("warning"), "error", F.lit(wrap).alias("wrap"),
    ))


def _patched(requests: DataFrame) -> DataFrame:
    return requests.where("status = 'success' AND kind = 'mp3' AND steps <> 0")


def report(requests: DataFrame) -> DataFrame:
    """The result row of every file."""
    patched = (F.col("status") == "success") & (F.col("kind") == "mp3") & (F.col("steps") != 0)
    return requests.select(
        *[c for c in requests.columns if c in ("album", "track")], F.col("path").alias("file"), "status",
        F.when(patched, F.col("frames")).alias("frames"), "loudness_db", "peak", F.col("steps").alias("gain_applied_steps"),
        F.col("applied_db").alias("gain_applied_db"), "warning", "error",
        F.when(F.col("status") == "dry_run", F.lit(True)).alias("dry_run"),
    )


def patches(requests: DataFrame, gains: DataFrame, wrap: bool = False) -> DataFrame:
    """The gain fields that change, from which value to which; nothing for skipped, failed and tagged files."""
    return GP.plan_gain(gains, _patched(requests).select("path", "steps"), wrap=wrap)


def ledger_rows(requests: DataFrame, ts: Column, id_: Column) -> DataFrame:
    """Ledger entries of the files that are patched."""
    return _patched(requests).select(
        "path", ts.alias("ts"), id_.cast("bigint").alias("id"), F.lit(None).cast("int").alias("channel"), "steps", "wrap",
        F.col("min_gain").cast("int").alias("min_gain"), F.col("max_gain").cast("int").alias("max_gain"))


def tag_rows(requests: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Tags to write, (path, pos, key, value): undo and gain range for patched files, levels for the others.

    ``before`` is the ``ledger_state`` before this run: undo values add up and the range stays the first one.
    """
    done = requests.where("status = 'success'")
    none = F.lit(0).cast("bigint")
    if before is None:
        done = done.withColumns({"__left": none, "__right": none, "__range": F.lit(None).cast("string")})
    else:
        known = before.select("path", F.col("left_undo").alias("__left"), F.col("right_undo").alias("__right"), F.col("minmax").alias("__range"))
        done = join_null_safe(done, known, ["path"])
    left, right = (F.coalesce(c, none) + F.col("steps") for c in ("__left", "__right"))
    span = F.coalesce("__range", F.when(F.col("min_gain").isNotNull(), T.format_minmax(F.col("min_gain"), F.col("max_gain"))))
    undo = F.array(F.struct(F.lit(UNDO_KEY).alias("key"), T.format_undo(left, right, F.col("wrap")).alias("value")),
                   F.struct(F.lit(MINMAX_KEY).alias("key"), span.alias("value")))
    pair = T.level_tags(F.col("gain_db"), F.col("peak"))
    both = T.level_tags(F.col("gain_db"), F.col("peak"), F.col("album_gain_db"), F.col("album_peak"))
    levels = F.when(F.col("album_gain_db").isNull(), pair).otherwise(both)
    items = F.when(F.col("kind") != "mp3", levels).when(F.col("steps") != 0, undo)
    return done.select("path", F.posexplode(items).alias("pos", "tag")).select("path", "pos", "tag.key", "tag.value").where(F.col("value").isNotNull())
