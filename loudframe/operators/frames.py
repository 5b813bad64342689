"""Statistics of frame and gain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import headers as H
from loudframe.functions import levels as L

NO_FRAMES = "No valid MP3 frames found"


def valid_frames(frames: DataFrame, word: str = "header_word") -> DataFrame:
    """Rows whose header word is a usable layer III header."""
    return frames.where(H.is_valid_header(F.col(word)))


def decode_frames(frames: DataFrame, word: str = "header_word") -> DataFrame:
    """Add the decoded header fields."""
    return frames.withColumn("__h", H.decode_header(F.col(word))).select(*frames.columns, "__h.*")


def format_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The header tables as dimensions: (version, index) -> bitrate and -> sample rate."""
    kbps = [("MPEG1", i, v) for i, v in enumerate(C.BITRATES_V1) if i]
    kbps += [(name, i, v) for name in ("MPEG2", "MPEG2.5") for i, v in enumerate(C.BITRATES_V2) if i]
    rates = [(name, i, v) for name, values in C.FRAME_RATES.items() for i, v in enumerate(values)]
    return (
        spark.createDataFrame(kbps, "mpeg_version string, bitrate_index int, bitrate_kbps int"),
        spark.createDataFrame(rates, "mpeg_version string, rate_index int, sample_rate int"),
    )


def join_format_tables(frames: DataFrame, word: str = "header_word") -> DataFrame:
    """Bitrate and sample rate by lookup; both tables have a fixed size (42 and 9 rows)."""
    kbps, rates = format_tables(frames.sparkSession)
    w = F.col(word)
    keyed = frames.select(
        "*",
        H.version(w).alias("mpeg_version"),
        F.shiftright(w, 12).bitwiseAND(F.lit(15)).cast("int").alias("bitrate_index"),
        F.shiftright(w, 10).bitwiseAND(F.lit(3)).cast("int").alias("rate_index"),
    )
    keyed = keyed.join(F.broadcast(kbps), ["mpeg_version", "bitrate_index"], "left")
    return keyed.join(F.broadcast(rates), ["mpeg_version", "rate_index"], "left").drop("bitrate_index", "rate_index")


def with_layout(frames: DataFrame) -> DataFrame:
    """Add version, channel mode and the hex digits of the side information, each computed once."""
    word = F.col("header_word")
    return frames.withColumns({
        "__v": H.version(word), "__m": H.channel_mode(word), "__x": F.hex("side_info"),
    })


def gain_rows(frames: DataFrame) -> DataFrame:
    """One row per granule and channel with the position and value of its gain field."""
    gains = H.frame_gains(F.col("header_word"), F.col("side_info"), F.col("frame_offset"))
    return frames.select("path", "frame_no", F.explode(gains).alias("g")).select("path", "frame_no", "g.*")


def _summary(gains: DataFrame, keys: Sequence[str], *aggs) -> DataFrame:
    out = gains.groupBy(*keys).agg(*aggs)
    return out.withColumn("headroom_steps", L.field_headroom_steps(F.col("max_gain"))).withColumn(
        "headroom_db", L.field_headroom_db(F.col("max_gain"))
    )


def frame_stats(frames: DataFrame, path: str = "path") -> DataFrame:
    """A1: frame count, gain range and average, version and channel mode of the first frame.

    The gains of a frame are reduced inside its row, so one row per frame is aggregated.
    """
    shaped = with_layout(frames)
    fields = [H.gain_column(F.col("__v"), F.col("__m"), F.col("__x"), i).alias(f"__g{i}") for i in range(4)]
    gains = [F.col(f"__g{i}") for i in range(4)]
    per_frame = shaped.select(F.col(path), "frame_offset", F.col("__v").alias("v"), F.col("__m").alias("m"), *fields).select(
        F.col(path),
        "frame_offset",
        "v",
        "m",
        F.least(*gains).alias("lo"),
        F.greatest(*gains).alias("hi"),
        sum((F.coalesce(g, F.lit(0)) for g in gains), F.lit(0).cast("bigint")).alias("sum"),
        sum((F.when(g.isNotNull(), 1).otherwise(0) for g in gains), F.lit(0)).alias("cnt"),
    )
    return _summary(
        per_frame,
        [path],
        F.count(F.lit(1)).alias("frames"),
        F.min_by("v", "frame_offset").alias("mpeg_version"),
        F.min_by("m", "frame_offset").alias("channel_mode"),
        F.min("lo").alias("min_gain"),
        F.max("hi").alias("max_gain"),
        (F.sum("sum") / F.sum("cnt")).alias("avg_gain"),
    )


def gain_stats(gains: DataFrame, keys: Sequence[str] = ("path",), frame: Sequence[str] | None = None,
               gain: str = "gain") -> DataFrame:
    """A1 on a gain table: frames, min, max, average and headroom per key.

    A frame has exactly one field of granule 0 and channel 0, so counting those needs a single
    aggregation that shrinks before it shuffles. For tables without that property ``frame``
    names the columns whose distinct values are frames; rows are then reduced per frame
    first, so that one file with a large part of all rows still spreads over the cluster.
    """
    if frame is None:
        first = (F.col("gr") == 0) & (F.col("ch") == 0)
        return _summary(
            gains, keys, F.count_if(first).alias("frames"), F.min(gain).alias("min_gain"), F.max(gain).alias("max_gain"),
            F.avg(gain).alias("avg_gain"),
        )
    per_frame = gains.groupBy(*keys, *frame).agg(
        F.min(gain).alias("lo"), F.max(gain).alias("hi"), F.sum(gain).alias("sum"), F.count(gain).alias("cnt")
    )
    return _summary(
        per_frame, keys, F.count(F.lit(1)).alias("frames"), F.min("lo").alias("min_gain"), F.max("hi").alias("max_gain"),
        (F.sum("sum") / F.sum("cnt")).alias("avg_gain"),
    )


def gain_minmax(gains: DataFrame, keys: Sequence[str] = ("path",), gain: str = "gain") -> DataFrame:
    """A2: gain range only, with the peak estimated from it."""
    found = gains.groupBy(*keys).agg(F.min(gain).alias("min_gain"), F.max(gain).alias("max_gain"))
    return found.withColumn("estimated_peak", L.estimated_peak(F.col("max_gain")))


def stats_or_error(files: DataFrame, stats: DataFrame, path: str = "path") -> DataFrame:
    """Every file with its statistics, or the error that it has no frames."""
    joined = files.join(stats, path, "left")
    return joined.withColumn("error", F.when(F.col("frames").isNull(), F.lit(NO_FRAMES)))


def join_measures(levels: DataFrame, fields: DataFrame, path: str = "path") -> DataFrame:
    """Loudness rows with the gain range of the file; (1.0, 255, 0) where it could not be read."""
    joined = levels.join(fields, path, "left")
    return joined.withColumns({
        "max_amplitude": F.coalesce("max_amplitude", F.lit(1.0)),
        "max_gain": F.coalesce("max_gain", F.lit(C.GAIN_MAX)),
        "min_gain": F.coalesce("min_gain", F.lit(C.GAIN_MIN)),
    })
