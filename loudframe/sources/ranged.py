"""Reading the few bytes of a file that hold its tags, wherever they lie, and writing files from rows.

``binaryFile`` holds a whole file in one value, so it reads gigabytes for a tag of some hundred bytes and can't
load a file of 2 GiB. This source lists a folder once and lets each task seek: box headers are
followed to the metadata, and trailing tags are read from the end.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loudframe import constants as C

SCHEMA = "path string, length bigint, content binary, bytes_read bigint, error string"
FORMAT = "tag_regions"
#: Files of a task, at most; their sizes don't matter, since a task reads a few KB of each.
FILES_PER_TASK = 2_000
#: Files and bytes of a batch of rows, about.
BATCH_FILES, BATCH_BYTES = 500, 1 << 20
#: A trailing tag's footer, before which a tag of 128 bytes of the older kind may lie.
FOOTER, TAIL = 32, 160


class _Counted:
    """A file that is read in ranges, and how many bytes were."""

    def __init__(self, source, length: int):
        self._source, self.length, self.read_bytes = source, length, 0

    def at(self, start: int, size: int) -> bytes:
        size = max(0, min(size, self.length - start))
        if not size:
            return b""
        self._source.seek(start)
        out = self._source.read(size)
        self.read_bytes += len(out)
        return out


def _find_box(file: _Counted, kind: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Content start and end of the first box of a kind in a span; reads headers only, stops at the first broken one."""
    end = min(end, file.length)
    while at + 8 <= end:
        head = file.at(at, 16)
        size, found = struct.unpack_from(">I4s", head)
        used = 8
        if size == 1:
            if at + 16 > end:
                return None
            size, used = struct.unpack_from(">Q", head, 8)[0], 16
        if size < used:
            return None
        if found == kind:
            return at + used, at + size
        at += size
    return None


def _box(kind: bytes, inner: bytes) -> bytes:
    return struct.pack(">I4s", len(inner) + 8, kind) + inner


def metadata_boxes(file: _Counted) -> bytes:
    """The item list of a box-structured file in the boxes that lead to it, without all others; empty if there is none."""
    span = 0, file.length
    for kind, skip in ((b"moov", 0), (b"udta", 0), (b"meta", 4), (b"ilst", 0)):
        inner = _find_box(file, kind, *span)
        if inner is None:
            return b""
        span = inner[0] + skip, inner[1]
    items = file.at(span[0], min(span[1], file.length) - span[0])
    return _box(b"moov", _box(b"udta", _box(b"meta", b"\0\0\0\0" + _box(b"ilst", items))))


def trailing_tag(file: _Counted) -> bytes:
    """The end of a file from the first byte of its trailing tag on; its last bytes if it has none."""
    tail = file.at(max(0, file.length - TAIL), TAIL)
    for back in (FOOTER, TAIL):
        foot = tail[len(tail) - back:len(tail) - back + FOOTER] if len(tail) >= back else b""
        if foot[:8] != C.APE_PREAMBLE or back == TAIL and tail[len(tail) - 128:len(tail) - 125] != b"TAG":
            continue
        version, size = struct.unpack_from("<II", foot, 8)
        start = file.length - back + FOOTER - size
        if version == C.APE_VERSION and start >= 0 and size + back - FOOTER > len(tail):
            return file.at(start, file.length - start)
        break
    return tail


_REGIONS = {"mp4": metadata_boxes, "ape": trailing_tag}


class _Files(InputPartition):
    def __init__(self, root: str, files: list[tuple[str, int]]):
        self.root, self.files = root, files


class _Reader(DataSourceReader):
    def __init__(self, root: str, kind: str, extensions: tuple[str, ...], per_task: int):
        self._root, self._kind, self._extensions, self._per_task = root, kind, extensions, per_task

    def partitions(self) -> list[_Files]:
        system, root = fs.FileSystem.from_uri(self._root)
        found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(root, recursive=True))
                       if i.type == fs.FileType.File and i.base_name[0] not in "._" and (not self._extensions or i.extension.lower() in self._extensions))
        return [_Files(self._root, found[i:i + self._per_task]) for i in range(0, max(len(found), 1), self._per_task)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, region = fs.FileSystem.from_uri(partition.root)[0], _REGIONS[self._kind]
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("bytes_read", pa.int64()), ("error", pa.string())])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), schema.types)], schema=schema)

        for path, length in partition.files:
            content, read, error = None, 0, None
            try:
                with system.open_input_file(path) as source:
                    file = _Counted(source, length)
                    content, read = region(file), file.read_bytes
            except OSError as e:  # a file that can't be opened is a row with its error, not the end of the job
                error = f"Failed to open: {e}"
            rows.append((path, length, content, read, error))
            size += len(content or b"")
            if len(rows) == BATCH_FILES or size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class TagRegions(DataSource):
    """``spark.read.format("tag_regions").option("kind", "mp4" | "ape").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        kind = self.options.get("kind", "mp4")
        if kind not in _REGIONS:
            raise ValueError("kind must be 'mp4' or 'ape'")
        chosen = tuple(e.strip().lower() for e in self.options.get("extensions", "").split(",") if e.strip())
        return _Reader(self.options["path"], kind, chosen, int(self.options.get("files_per_task", FILES_PER_TASK)))


def read_regions(spark: SparkSession, folder: str, kind: str, extensions: tuple[str, ...] = (), files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """(path, length, content, bytes_read, error) of the files below a folder, ``content`` only what holds the tags.

    ``mp4_tag_rows`` and ``ape_tag_rows`` give the same tags from it as from whole contents. Files of any size are
    read; the folder may be on any file system that Arrow opens (local, HDFS, object stores).
    """
    spark.dataSource.register(TagRegions)
    reader = spark.read.format(FORMAT).option("kind", kind).option("extensions", ",".join(extensions)).option("files_per_task", files_per_task)
    return reader.load(folder)


def write_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write each row's bytes to the file that its path names below a folder; returns (path, length), and writes when that is counted or stored.

    A file appears under its name when it is complete, and a task that runs again writes the same files.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            names, data = batch.column(0).to_pylist(), batch.column(1)
            for i, name in enumerate(names):
                target = f"{root}/{name}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                temporary = f"{parent}/.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temporary) as out:
                    out.write(data[i].as_buffer() or b"")
                system.move(temporary, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_length(data), 0).cast(pa.int64())], names=["path", "length"])

    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(put, "path string, length bigint")
