"""A table that batches add to, kept as one snapshot and a few deltas.

Each batch is a folder of its own. A manifest says which folders count: the latest snapshot and the
deltas after it. After ``every`` deltas the batch that comes next merges snapshot and deltas into a new
snapshot, so a read opens a bounded number of folders however many batches there were. A batch
number that a manifest has already counted is not counted again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Manifest:
    """``version`` counts manifests; ``last`` is the highest batch of each writer."""

    version: int = -1
    snapshot: str | None = None
    deltas: list[str] = field(default_factory=list)
    last: dict[str, int] = field(default_factory=dict)
    old: list[str] = field(default_factory=list)

    @property
    def folders(self) -> list[str]:
        return [*([self.snapshot] if self.snapshot else []), *self.deltas]


class Files:
    """The few file operations of the store, on whatever file system the table lies."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write under another name, then rename; False if the name is taken already."""
        temporary = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(temporary), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(self.path(name)) and self._fs.rename(self.path(temporary), self.path(name)):
            return True
        self._fs.delete(self.path(temporary), False)
        return False

    def drop(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class MergedTable:
    """A table below ``root``; ``merge`` makes one table of the union of several states of it.

    With ``every=None`` batches are only listed, as suits a table of events that don't merge.

    One writer at a time; readers at any time. Folders that no longer count stay until the next merge
    but one, so that a read which began before goes on undisturbed.
    """

    def __init__(self, spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], every: int | None = 8):
        self._spark, self._root, self._merge, self._every = spark, root.rstrip("/"), merge, every
        self._files = Files(spark, root)

    def manifest(self) -> Manifest:
        names = [n for n in self._files.names(f"{self._root}/_manifest") if n.isdigit()]
        return Manifest(**json.loads(self._files.read(f"{self._root}/_manifest/{max(names)}"))) if names else Manifest()

    def _folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self._spark.read.parquet(*[f"{self._root}/{f}" for f in folders]) if folders else None

    def add(self, batch: DataFrame, batch_id: int, writer: str = "") -> bool:
        """Count a batch; False if it has been counted before.

        The rows are written first and count from the moment their manifest appears, so an attempt
        that dies in between leaves a folder that nobody reads.
        """
        state = self.manifest()
        if batch_id <= state.last.get(writer, -1):
            return False
        delta = self._folder("delta")
        batch.write.parquet(f"{self._root}/{delta}")
        after = Manifest(state.version + 1, state.snapshot, [*state.deltas, delta], {**state.last, writer: batch_id}, state.old)
        if self._every is not None and len(after.deltas) > self._every:
            snapshot = self._folder("snapshot")
            self._merge(self._read(after.folders)).write.parquet(f"{self._root}/{snapshot}")
            for folder in state.old:
                self._files.drop(f"{self._root}/{folder}")
            after = Manifest(after.version, snapshot, [], after.last, after.folders)
        if not self._files.write_new(f"{self._root}/_manifest/{after.version:012d}", json.dumps(after.__dict__)):
            raise RuntimeError(f"another writer has added to {self._root}")
        for name in self._files.names(f"{self._root}/_manifest"):
            if name.isdigit() and int(name) < after.version - 1:
                self._files.drop(f"{self._root}/_manifest/{name}")
        return True

    def read(self) -> DataFrame:
        """All that has been counted, merged."""
        rows = self._read(self.manifest().folders)
        if rows is None:
            raise ValueError(f"nothing has been added to {self._root}")
        return self._merge(rows)
