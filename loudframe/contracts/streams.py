"""Streaming operators, run over the tables until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.contracts.roles import LEDGER, PATHS, contract, ledger, packets, paths, table
from loudframe.contracts.signal import FILTERED
from loudframe.operators import filtering as FI
from loudframe.session import fresh_path
from loudframe.sources import catalog as CA
from loudframe.streaming import filter as SF
from loudframe.streaming import ledger as SLE
from loudframe.streaming import levels as SL


def _replay(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of files: they are the first and only arrival."""
    source, schema = f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(source)
    # The source of streams takes folders only.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@contract("""
WITH w AS (SELECT user_id AS track, time_bucket(INTERVAL '1 hour', ts) AS ws, sum(2 * v * v)::DOUBLE AS ss, count(*) AS n
           FROM (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL),
b AS (SELECT track, CAST(trunc(1000e0 * log10(ss / n * 0.5e0 + 1e-37)) AS INTEGER) + 2000 AS bin FROM w
      WHERE ws + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes')
SELECT track, bin, count(*) AS cnt FROM b WHERE bin BETWEEN 0 AND 11999 GROUP BY ALL""")
def stream_levels(spark, sf_dir):
    """Hourly windows; those still open at the watermark are not counted yet."""
    rows = _replay(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )
    windows = SL.stream_windows(rows, ["track"], "ts", F.col("v"), width="1 hour", delay="10 minutes")
    target = fresh_path(spark, "stream-levels")
    SL.write_histogram(windows, ["track"], f"{target}/table", f"{target}/checkpoint").awaitTermination()
    return SL.read_histogram(spark, ["track"], f"{target}/table").select("track", "bin", "cnt")


@contract(f"""
WITH {LEDGER}
SELECT path, CAST(sum(steps) AS BIGINT) AS undo, count(*) AS entries,
       first(min_gain || ',' || max_gain ORDER BY ts, id) FILTER (WHERE min_gain IS NOT NULL) AS minmax
FROM l GROUP BY path""")
def stream_ledger(spark, sf_dir):
    rows = ledger(_Replay(spark), sf_dir)
    target = fresh_path(spark, "stream-ledger")
    SLE.write_state(SLE.stream_ledger(rows), f"{target}/table", f"{target}/checkpoint").awaitTermination()
    return SLE.read_state(spark, ["path"], f"{target}/table")


class _Replay:
    """Lets a role read its table as a stream."""

    def __init__(self, spark):
        self._spark = spark
        self.read = self

    def parquet(self, path):
        folder, name = path.rsplit("/", 1)
        return _replay(self._spark, folder, name.removesuffix(".parquet"))


def _filtered_live(spark, windows):
    target = fresh_path(spark, "stream-filter")
    with SF.state_store(spark):
        (
            windows.writeStream.format("parquet").outputMode("append").option("path", f"{target}/table")
            .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.parquet(f"{target}/table")


@contract(f"""
WITH {FILTERED}
SELECT track, n // 2205 AS window_no, count(*) AS samples, round(sum(2e0 * z * z) / 1e6) AS energy FROM z GROUP BY ALL""")
def stream_filter_ends(spark, sf_dir):
    """All windows of tracks that end: the short last one comes out with the marked last packet."""
    ends = packets(spark, sf_dir).groupBy("track").agg(F.max("packet_no").alias("end_no"))
    rows = packets(_Replay(spark), sf_dir).join(ends, "track").withColumn("is_end", F.col("packet_no") == F.col("end_no"))
    live = _filtered_live(spark, SF.stream_filter(rows, ends="is_end"))
    return live.select("track", "window_no", "samples", F.round(F.col("sum_squares") / 1e6).alias("energy"))


@contract(f"""
WITH {FILTERED}
SELECT track, n // 2205 AS window_no, count(*) AS samples, round(sum(2e0 * z * z) / 1e6) AS energy, TRUE AS same_as_batch
FROM z GROUP BY ALL HAVING count(*) = 2205""")
def stream_filter(spark, sf_dir):
    """Complete 50 ms windows of the filtered packets, equal to the batch result."""
    live = _filtered_live(spark, SF.stream_filter(packets(_Replay(spark), sf_dir))).select("track", "window_no", "sum_squares", "samples")
    batch = FI.filter_window_sums(packets(spark, sf_dir)).select(
        "track", "window_no", F.col("sum_squares").alias("batch_sum")
    )
    close = F.abs(F.col("sum_squares") / F.col("batch_sum") - 1) < 1e-6
    return live.join(batch, ["track", "window_no"], "left").select(
        "track", "window_no", "samples", F.round(F.col("sum_squares") / 1e6).alias("energy"), close.alias("same_as_batch")
    )


@contract(f"""
WITH {PATHS}
SELECT path, length FROM f WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp3', 'm4a', 'aac', 'mp4')""")
def incremental_catalog(spark, sf_dir):
    """New paths are appended to a JSON log once; a second run finds nothing new."""
    found = CA.catalog_filter(paths(_Replay(spark), sf_dir), extensions=C.AUDIO_EXTENSIONS, skip_forks=False)
    target = fresh_path(spark, "incremental-catalog")
    for _ in range(2):
        CA.append_new_files(found.select("path", "length"), f"{target}/log", f"{target}/checkpoint").awaitTermination()
    return spark.read.schema("path string, length bigint").json(f"{target}/log")
