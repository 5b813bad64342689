"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe.session import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; every other character, accented capitals included, stays."""
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage like a checkpoint, but later reads take only the columns they need and values
    such as generated row numbers can't change between two reads.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand at most ``rows`` rows at a time to Python workers, so that long texts fill neither side's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    now = int(before)
    spark.conf.set(name, str(min(now, rows) if now > 0 else rows))  # 0 and less: no bound
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of whole texts that a worker gets at a time: with more, Spark's buffers for a batch double beyond what it keeps in pools.
TEXT_ROWS = 1_000


def bounded_sample(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` different rows, those with the smallest hashes of all their values; equal rows count once.

    Only hashes are sorted, and as many of them as the limit, so the bound holds however often an id is repeated.
    """
    key = unique_name(rows, "__key")
    keyed = rows.withColumn(key, F.xxhash64(*rows.columns))
    last = keyed.select(key).distinct().orderBy(key).limit(limit).agg(F.max(key)).first()[0]
    return keyed.where(F.col(key) <= F.lit(last)).dropDuplicates([key]).drop(key)


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"{stem}_{uuid.uuid4().hex[:6]}"
    return stem


def remainder_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process.

    Functions travel to workers by value, module globals with them; what a worker keeps between
    tasks therefore lives in a module that is made there and never pickled.
    """
    holder = sys.modules.setdefault("_loudframe_worker", types.ModuleType("_loudframe_worker"))
    return holder.__dict__.setdefault(name, {})


def release_memory() -> None:
    """What this worker no longer uses goes back to the system: Arrow's pool and the C library keep freed memory, and a worker is used again.

    Without the C library's call only Arrow's pool is released.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with the worker's unused memory released before its first batch and after its last."""
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        yield from run(batches)
        release_memory()
    return released


def one_thread() -> None:
    """Matrix products of this worker run in one thread: Spark has a task for each core, and threads that wait for each other burn it.

    The library reads its own variable only when it is loaded, so its setter is called; without one nothing changes.
    """
    if worker_cache("threads"):
        return
    worker_cache("threads")["set"] = True
    for file in Path(np.__file__).resolve().parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(file))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, A-Z in small letters if asked, and how many each text has. Null has none.

    Words are lowered after the cut: Arrow's lower-casing breaks the offsets of a sliced array.
    """
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, sizes = cut.flatten(), np.diff(cut.offsets.to_numpy())
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at the ends of a text leaves empty words
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[real], minlength=len(texts))
    words = words.filter(pa.array(real))
    return pc.ascii_lower(words) if lower else words, sizes


def text_parts(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // size
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at], side="right")))
        yield batch.slice(at, to - at)
        at = to
