"""Decoded packets of one audio stream per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_stream(packets: DataFrame, keys: Sequence[str] = ("album", "track"), index: int = 0,
                  stream: str = "stream_no", samples: str = "left") -> DataFrame:
    """Packets of the chosen stream; packets that could not be decoded (NULL samples) are skipped."""
    return packets.where((F.col(stream) == index) & F.col(samples).isNotNull())


def stream_errors(packets: DataFrame, keys: Sequence[str] = ("album", "track"), index: int = 0,
                  stream: str = "stream_no") -> DataFrame:
    """One error row per file that has no stream with this index."""
    streams = packets.groupBy(*keys).agg((F.max(stream) + 1).alias("streams"))
    text = F.format_string("Track index %d out of range (file has %d audio track(s))", F.lit(index), F.col("streams"))
    return streams.where(F.col("streams") <= index).select(
        *keys, F.lit("error").alias("status"), text.alias("error")
    )
