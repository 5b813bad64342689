"""From file contents to tables: frames and tags.

Only what has no columnar form runs in Python: following the frame chain of a file, and the
nested length-prefixed records of tags. Fields are decoded afterwards by column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loudframe import constants as C
from loudframe import schemas
from loudframe.functions import headers as H

SIDE_BYTES = 32
OUTPUT_ROWS = 65536
_ITEM = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
_ITEMS = T.ArrayType(_ITEM)


# --- frames -----------------------------------------------------------------------


def _starts_with(content: Column, at: Column, magic: bytes) -> Column:
    return F.substring(content, at + 1, F.lit(len(magic))) == F.lit(magic)


def with_audio_span(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``start`` and ``end`` of the frame area: after a leading ID3v2 tag, before trailing tags.

    Built in stages, so that each value is computed once.
    """
    data, size = F.col(content), F.length(content)
    has_id3 = (size >= 10) & _starts_with(data, F.lit(0), b"ID3")
    has_v1 = (size >= 128) & _starts_with(data, size - 128, b"TAG")
    staged = files.withColumns({
        "start": F.when(has_id3, F.lit(10) + H.synchsafe(F.substring(content, 7, 4))).otherwise(F.lit(0)).cast("bigint"),
        "end": F.when(has_v1, size - 128).otherwise(size).cast("bigint"),
    })
    staged = staged.withColumn("__foot", F.when(F.col("end") >= 32, F.substring(data, F.col("end").cast("int") - 31, F.lit(32))))
    headed = H.uint32_le(F.substring("__foot", 21, 4)) >= 2**31
    whole = H.uint32_le(F.substring("__foot", 13, 4)) + F.when(headed, 32).otherwise(0)
    is_ape = F.substring("__foot", 1, 8) == F.lit(C.APE_PREAMBLE)
    staged = staged.withColumn("__tag", F.when(is_ape, whole))
    cut = F.when(F.col("__tag") <= F.col("end"), F.col("end") - F.col("__tag")).otherwise(F.col("end"))
    return staged.withColumn("end", cut).drop("__foot", "__tag")


def _frame_table() -> np.ndarray:
    """Frame bytes for the eleven header bits that set them: version, bitrate, rate, padding.

    Zero marks combinations that are no frame.
    """
    sizes = np.zeros((4, 16, 4, 2), np.int64)
    for bits, name in ((3, "MPEG1"), (2, "MPEG2"), (0, "MPEG2.5")):
        kbps = C.BITRATES_V1 if name == "MPEG1" else C.BITRATES_V2
        samples = 1152 if name == "MPEG1" else 576
        for i, rate in enumerate(C.FRAME_RATES[name]):
            for j in range(1, 15):
                sizes[bits, j, i] = samples * kbps[j] * 125 // rate + np.arange(2)
    return sizes


_SIZES = _frame_table()
_SECOND_BYTE = np.zeros(256, bool)
_SECOND_BYTE[[0xFA, 0xFB, 0xF2, 0xF3, 0xE2, 0xE3]] = True


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sum(data[at + k].astype(np.int64) << (24 - 8 * k) for k in range(4))


def _frame_starts(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Offsets of all frames of a batch of files laid end to end, and the file of each.

    File ``i`` covers ``bounds[i]..bounds[i+1]``, its frame area ``first[i]..last[i]``. All
    positions are tested at once; the walk then hops over accepted positions only. Leaving
    one file, the next accepted position is the first one of the next file.
    """
    at = np.flatnonzero(data[:-3] == 0xFF)
    at = at[_SECOND_BYTE[data[at + 1]]]
    file = np.searchsorted(bounds[:-1], at, "right") - 1
    b1, b2 = data[at + 1].astype(np.int64), data[at + 2].astype(np.int64)
    size = _SIZES[(b1 >> 3) & 3, b2 >> 4, (b2 >> 2) & 3, (b2 >> 1) & 1]
    end, after = last[file], at + size
    inside = after + 2 <= end
    probe = np.where(inside, after, 0)
    synced = (data[probe] == 0xFF) & ((data[probe + 1] & 0xE0) == 0xE0)
    good = (size > 0) & (at >= first[file]) & (at + 4 <= end) & np.where(inside, synced, after <= end)
    at, after, file = at[good], after[good], file[good]
    follow = np.searchsorted(at, after).tolist()
    chain, i = [], 0
    while i < len(follow):
        chain.append(i)
        i = follow[i]
    return at[chain], file[chain]


def _is_info_frame(data: np.ndarray, at: np.ndarray, file_end: np.ndarray) -> np.ndarray:
    """Frames that carry a stream summary ('Xing' or 'Info') instead of audio."""
    full = (data[at + 1] >> 3) & 3 == 3
    mono = data[at + 3] >> 6 == 3
    side = np.where(full, np.where(mono, 17, 32), np.where(mono, 9, 17))
    spot = at + np.where(data[at + 1] & 1 == 0, 6, 4) + side
    whole = spot + 4 <= file_end
    word = _word(data, np.where(whole, spot, at))
    return whole & ((word == int.from_bytes(b"Xing")) | (word == int.from_bytes(b"Info")))


def _side_info(data: np.ndarray, at: np.ndarray, file_end: np.ndarray) -> pa.Array:
    """The side information bytes after each header, shorter at the end of a file."""
    start = at + np.where(data[at + 1] & 1 == 0, 6, 4)
    length = np.clip(file_end - start, 0, SIDE_BYTES)
    grid = np.minimum(start[:, None] + np.arange(SIDE_BYTES), len(data) - 1)
    flat = data[grid][np.arange(SIDE_BYTES) < length[:, None]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _frames_of_batch(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    path, content, start, end = batch.columns
    width = np.int64 if pa.types.is_large_binary(content.type) else np.int32
    _, index, body = content.buffers()
    if body is None or not len(content):
        return None
    bounds = np.frombuffer(index, width)[content.offset:content.offset + len(content) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    if len(data) < 4:
        return None
    first = bounds[:-1] + start.fill_null(0).to_numpy()
    last = bounds[:-1] + end.fill_null(0).to_numpy()
    at, file = _frame_starts(data, bounds, first, last)
    audio = ~_is_info_frame(data, at, bounds[file + 1])
    at, file = at[audio], file[audio]
    if not len(at):
        return None
    number = np.arange(len(at)) - np.searchsorted(file, file)
    return pa.RecordBatch.from_arrays(
        [path.take(pa.array(file)).cast(pa.string()), pa.array(number), pa.array(at - bounds[file]),
         pa.array(_word(data, at)), _side_info(data, at, bounds[file + 1])],
        names=["path", "frame_no", "frame_offset", "header_word", "side_info"],
    )


def frame_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per audio frame with its header word and raw side information.

    Arrow batches are bounded in bytes, so a batch holds many small files or one large one.
    """
    named = files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = _frames_of_batch(batch)
            if frames is not None:
                for i in range(0, frames.num_rows, OUTPUT_ROWS):
                    yield frames.slice(i, OUTPUT_ROWS)

    return with_audio_span(named).mapInArrow(walk, schemas.FRAMES)


# --- APEv2 tags -----------------------------------------------------------------------


def ape_regions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Per file the item bytes and item count of its trailing tag, NULL without a usable tag.

    Found with column expressions, so that Python only receives the few bytes of the tag.
    """
    data, size = F.col(content), F.length(content)
    at_end = (size >= 32) & _starts_with(data, size - 32, C.APE_PREAMBLE)
    before_v1 = (size >= 160) & _starts_with(data, size - 160, C.APE_PREAMBLE) & _starts_with(data, size - 128, b"TAG")
    found = files.select(
        F.col(path).alias("path"), data.alias("content"), F.when(at_end, size - 32).when(before_v1, size - 160).alias("at")
    )
    found = found.withColumn("foot", F.substring("content", F.col("at") + 1, F.lit(32)))
    field = lambda offset: H.uint32_le(F.substring("foot", offset + 1, 4))
    found = found.select("path", "content", "at", field(8).alias("version"), field(16).alias("count"),
                         (F.col("at") + 32 - field(12)).alias("first"))
    usable = F.coalesce((F.col("version") == C.APE_VERSION) & (F.col("first") >= 0), F.lit(False))
    size = F.greatest(F.col("at") - F.col("first"), F.lit(0)).cast("int")
    items = F.substring("content", F.col("first").cast("int") + 1, size)
    return found.select("path", F.when(usable, items).alias("items"), F.when(usable, F.col("count")).alias("count"))


@F.pandas_udf(_ITEMS)
def _ape_items(regions: pd.Series, counts: pd.Series) -> pd.Series:
    def parse(region, count):
        if region is None:
            return None
        found, at = [], 0
        while len(found) < count and at + 8 <= len(region):
            size = int.from_bytes(region[at:at + 4], "little")
            key_end = region.find(b"\0", at + 8)
            if key_end < 0 or key_end + 1 + size > len(region):
                break
            value = region[key_end + 1:key_end + 1 + size]
            found.append({"key": region[at + 8:key_end].decode("utf-8", "replace"),
                          "value": value.decode("utf-8", "replace")})
            at = key_end + 1 + size
        return found

    return pd.Series([parse(r, c) for r, c in zip(regions, counts)], dtype=object)


def ape_tag_lists(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Per file its ordered tag items; NULL when the file has no tag."""
    region = ape_regions(files, path, content)
    return region.select("path", _ape_items(F.col("items"), F.col("count")).alias("items"))


def tag_rows(lists: DataFrame, namespace: str) -> DataFrame:
    """Tag lists in long form (path, namespace, pos, key, value)."""
    # The outer form, because Spark would add a filter on the list below a plain explode and
    # evaluate the Python function for it a second time.
    rows = lists.select("path", F.posexplode_outer("items").alias("pos", "item")).where(F.col("pos").isNotNull())
    return rows.select(
        "path", F.lit(namespace).alias("namespace"), "pos", F.col("item.key").alias("key"), F.col("item.value").alias("value")
    )


def ape_tag_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Tag rows of the APEv2 tag at the end of each file."""
    return tag_rows(ape_tag_lists(files, path, content), "APEv2")


# --- MP4 tags -----------------------------------------------------------------------


def _boxes(data: bytes, at: int, end: int):
    """(type, content start, box end) of the boxes in a span; stops at the first broken one."""
    end = min(end, len(data))
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        if size < head:
            return
        yield kind, at + head, at + size
        at += size


def _mp4_levels(data: bytes | None):
    if data is None:
        return None
    span = (0, len(data))
    for step, skip in ((b"moov", 0), (b"udta", 0), (b"meta", 4), (b"ilst", 0)):
        span = next(((s + skip, e) for kind, s, e in _boxes(data, *span) if kind == step), None)
        if span is None:
            return []
    names = {k.lower() for k in C.LEVEL_KEYS}
    found: dict[str, str] = {}
    for kind, start, end in _boxes(data, *span):
        if kind != b"----" or end > len(data):
            continue
        text = {}
        for part, s, e in _boxes(data, start, end):
            if e > end:
                break
            head = {b"mean": 4, b"name": 4, b"data": 8}.get(part)
            if head is not None and s + head < e:
                text[part] = data[s + head:e].decode("utf-8", "replace")
        key = text.get(b"name", "").lower()
        if len(text) == 3 and text[b"mean"] == C.MP4_NAMESPACE and key in names:
            found[key] = text[b"data"]
    return [{"key": k.lower(), "value": found[k.lower()]} for k in C.LEVEL_KEYS if k.lower() in found]


@F.pandas_udf(_ITEMS)
def _mp4_items(contents: pd.Series) -> pd.Series:
    return pd.Series([_mp4_levels(c) for c in contents], dtype=object)


def mp4_tag_lists(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Per file the level tags of its freeform metadata (an empty list when there are none)."""
    return files.select(F.col(path).alias("path"), _mp4_items(F.col(content)).alias("items"))


def mp4_tag_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Tag rows of the freeform metadata of each file."""
    return tag_rows(mp4_tag_lists(files, path, content), C.MP4_NAMESPACE)
