"""Catalogs of audio files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe import schemas
from loudframe.functions import paths as P
from loudframe.sources import listing as LI

#: Tasks a core that list files; a small file counts as so many bytes of a task of a stream (Spark's own 4 MB mean 32 files a task).
TASKS_PER_CORE, FILE_COST = 4, 64 << 10
#: The paths that a stream has seen lie on the executors' disks, and their caches have a bound.
_SEEN = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def _tasks(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def read_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True,
               modified_after: str | None = None, max_length: int | None = None) -> DataFrame:
    """Files with their content. Unused columns (above all ``content``) are not read.

    Spark holds a file's content in one value, so a file of 2 GiB or more cannot be loaded;
    ``max_length`` filters by length before content is touched (see ``oversize_files``).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    files = reader.load(paths if isinstance(paths, str) else list(paths))
    return files if max_length is None else files.where(F.col("length") <= max_length)


def oversize_files(catalog: DataFrame, max_length: int = 2**31 - 1) -> DataFrame:
    """Error rows for the files that ``max_length`` keeps out."""
    text = F.format_string("File too large: %d bytes", F.col("length"))
    return catalog.where(F.col("length") > max_length).select(
        F.col("path").alias("file"), F.lit("error").alias("status"), text.alias("error")
    )


def catalog_filter(files: DataFrame, path: str = "path", extensions: Sequence[str] = C.DESKTOP_EXTENSIONS,
                   skip_forks: bool = True) -> DataFrame:
    """Keep audio files by extension, by default without resource-fork names."""
    keep = P.is_desktop_audio if skip_forks else P.is_audio
    return files.where(keep(F.col(path), tuple(extensions)))


def audio_catalog(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True,
                  extensions: Sequence[str] = C.AUDIO_EXTENSIONS) -> DataFrame:
    """Path, length and modification time of the audio files below some directories.

    Tasks list the directories each time the rows are used. Where only Spark can open them (patterns, some stores), its own
    listing is read: it holds all files on the driver and leaves out those of no bytes.
    """
    roots = [LI.root_row(spark, p) for p in ([paths] if isinstance(paths, str) else paths)]
    if all(roots):
        files = LI.files_below(spark.createDataFrame(roots, LI.SCHEMA), _tasks(spark), recursive).select("path", "length", "modificationTime")
    else:
        files = read_files(spark, paths, recursive).select("path", "length", "modificationTime").coalesce(_tasks(spark))
    return catalog_filter(files, extensions=extensions, skip_forks=False)


def incremental_catalog(spark: SparkSession, path: str, extensions: Sequence[str] = C.AUDIO_EXTENSIONS) -> DataFrame:
    """A stream of newly added audio files; the sink's checkpoint remembers the known ones.

    Each trigger lists the tree by tasks and passes on the paths not seen before, which lie in the stream's state on the
    executors. The stream has a session of its own with a partition of that state for each core.
    Where only Spark can open the folder, its own stream of files is read, which keeps every file seen on the driver.
    """
    own = spark.newSession()
    root = LI.root_row(spark, path)
    if root is not None and root[-1]:
        for key, value in (_SEEN | {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}).items():
            own.conf.set(key, value)
        files = LI.files_below(LI.scans(own, root[0]), _tasks(spark)).select("path", "modificationTime", "length")
        return catalog_filter(files, extensions=extensions, skip_forks=False).dropDuplicates(["path"])
    own.conf.set("spark.sql.files.openCostInBytes", str(FILE_COST))
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(_tasks(spark)))
    files = (
        own.readStream.format("binaryFile").schema(schemas.FILES).option("recursiveFileLookup", True).load(path)
    )
    return catalog_filter(files, extensions=extensions, skip_forks=False)


def append_new_files(stream: DataFrame, target: str, checkpoint: str):
    """Append everything that has arrived since the last run to a JSON log, then stop."""
    return (
        stream.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def union_paths(explicit: DataFrame, expanded: DataFrame) -> DataFrame:
    """Named files and files found in directories; duplicates stay."""
    return explicit.unionByName(expanded)


def sort_catalog(catalog: DataFrame, path: str = "path") -> DataFrame:
    """O1: by path, byte by byte."""
    return catalog.orderBy(path)


def new_files_only(found: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """Paths not listed before, each once."""
    return found.join(known.select(path), path, "left_anti").dropDuplicates([path])


def new_files_summary(found: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """How many paths were added and how many skipped as duplicates."""
    counts = found.groupBy(path).agg(F.count(F.lit(1)).alias("times"))
    listed = known.select(path).distinct().withColumn("listed", F.lit(True))
    joined = counts.join(listed, path, "left")
    fresh = F.when(F.col("listed").isNull(), 1).otherwise(0)
    return joined.agg(
        F.coalesce(F.sum(fresh), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.col("times") - fresh), F.lit(0)).alias("skipped"),
    )


def select_rows(rows: DataFrame, selected: DataFrame, on: Sequence[str]) -> DataFrame:
    """The selected entries."""
    return rows.join(selected, list(on), "left_semi")


def drop_rows(rows: DataFrame, selected: DataFrame, on: Sequence[str]) -> DataFrame:
    """Everything but the selected entries."""
    return rows.join(selected, list(on), "left_anti")
