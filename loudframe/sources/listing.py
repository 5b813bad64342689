"""Folders listed by tasks: names, lengths and times of any number of files, of which the driver holds none.

Spark's own file sources keep an entry for each file on the driver, their streams for each file ever seen, and leave files
of no bytes out. Here a folder is a row: some steps list folders and deal those found over the cluster, the last walks on below them.
One folder without its subfolders is listed by one task.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified bigint, length bigint, folder boolean"
_ARROW = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("length", pa.int64()), ("folder", pa.bool_())])
FORMAT = "folder_scans"
#: Steps whose folders are dealt anew before the last one, and rows of a batch.
DEALT, BATCH_ROWS = 2, 5_000


def hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _opened(path: str) -> tuple[fs.FileSystem, str, str, str]:
    """The file system of a whole path, how Spark's and Arrow's names of its files begin, and the rest of the path.

    The rest is no part of the URI that Arrow decodes, so it may hold any character.
    """
    store, rest = re.fullmatch(r"([^:/]+:(?://[^/]*)?)(.*)", path, re.DOTALL).groups()
    system, base = fs.FileSystem.from_uri(f"{store}/")
    return system, store, base.rstrip("/"), rest


def root_row(spark: SparkSession, path: str) -> tuple[str, int | None, int | None, bool] | None:
    """A file or folder as the row that a listing begins with; None if Arrow can't open it (patterns, stores that only Spark reads)."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()
    try:
        system, _, base, rest = _opened(whole)
        info = system.get_file_info(base + rest)
    except (OSError, pa.ArrowException):
        return None
    if info.type == fs.FileType.Directory:
        return whole, None, None, True
    return (whole, info.mtime_ns // 1_000_000, info.size, False) if info.type == fs.FileType.File else None


def _listed(path: str) -> Iterator[pa.RecordBatch]:
    """What lies in a folder; nothing if it has gone meanwhile."""
    system, store, base, rest = _opened(path)
    found = [i for i in system.get_file_info(fs.FileSelector(base + rest, allow_not_found=True))
             if i.type in (fs.FileType.File, fs.FileType.Directory) and not hidden(i.base_name)]
    for k in range(0, len(found), BATCH_ROWS):
        part = found[k:k + BATCH_ROWS]
        folder = [i.type == fs.FileType.Directory for i in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array([store + i.path[len(base):] for i in part], pa.string()), pa.array([i.mtime_ns // 1_000_000 for i in part], pa.int64()),
             pa.array([None if d else i.size for i, d in zip(part, folder)], pa.int64()), pa.array(folder, pa.bool_())], schema=_ARROW)


def _step(rows: DataFrame, deep: bool) -> DataFrame:
    """Files as they are, folders replaced by what lies in them; ``deep`` goes on until no folder is left."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_folder = batch.column(3)
            yield batch.filter(pc.invert(is_folder))
            waiting = batch.column(0).filter(is_folder).to_pylist()
            while waiting:
                for found in _listed(waiting.pop()):
                    if deep:
                        waiting += found.column(0).filter(found.column(3)).to_pylist()
                        found = found.filter(pc.invert(found.column(3)))
                    yield found

    return rows.mapInArrow(step, SCHEMA)


def files_below(roots: DataFrame, tasks: int, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length) of the files in the folders that ``roots`` names; lists them each time it is used."""
    rows = _step(roots, deep=False)
    if recursive:
        for k in range(DEALT):
            # By the path, so that a task that runs again deals the same files to the same tasks.
            rows = _step(rows.repartition(tasks, "path"), deep=k == DEALT - 1)
    return rows.where(~F.col("folder")).select("path", F.timestamp_millis("modified").alias("modificationTime"), "length")


class _Scans(DataSourceStreamReader):
    def __init__(self, root: tuple[str, int | None, int | None, bool]):
        self._root = root

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield self._root


class FolderScans(DataSource):
    """A stream that names its folder again at each trigger, for a listing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Scans:
        return _Scans((self.options["path"], None, None, True))


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """The folder once per trigger."""
    spark.dataSource.register(FolderScans)
    return spark.readStream.format(FORMAT).load(folder)
