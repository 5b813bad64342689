"""Streams in several batches against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loudframe import schemas
from loudframe.contracts import QUERIES
from loudframe.operators import filtering as FI
from loudframe.operators import ledger as LE
from loudframe.operators import ordered as O
from loudframe.streaming import filter as SF
from loudframe.streaming import ledger as SLE
from loudframe.streaming import levels as SL


def test_filter_state_is_carried_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", SF.PROVIDER)
    rng = np.random.default_rng(1)
    x = rng.normal(size=20000) * 0.1
    rows = [("al", t, i, 44100, "F32", [float(v) * k for v in x[at:at + 1000]], None)
            for t, k in (("a", 1), ("b", 0.5)) for i, at in enumerate(range(0, 20000, 1000))]
    table = spark.createDataFrame(rows, schemas.PACKETS)

    def push(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        (SF.stream_filter(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination())

    push(table.where("packet_no < 7"))
    push(table.where("packet_no between 7 and 12"))
    push(table.where("packet_no > 12 or packet_no = 3"))  # packet 3 comes again, too late
    got = {(r.track, r.window_no): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.track, r.window_no): r for r in FI.filter_window_sums(O.packet_offsets(table)).collect() if r.samples == 2205}
    assert set(got) == set(want) and len(want) == 18
    for k, row in want.items():
        assert got[k].sum_squares == pytest.approx(row.sum_squares, rel=1e-9) and got[k].samples == row.samples
    assert max(r.late_packets for r in got.values()) == 1


def test_histogram_table_grows_by_merging(spark, tmp_path):
    def rows(seconds):
        return spark.createDataFrame([("t", s, float(v)) for s, v in seconds], "track string, s double, v double").select(
            "track", F.timestamp_millis((F.col("s") * 1000).cast("bigint")).alias("ts"), "v")

    def push(part):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        windows = SL.stream_windows(stream, ["track"], "ts", F.col("v"), width="1 second", delay="0 seconds")
        SL.write_histogram(windows, ["track"], str(tmp_path / "hist"), str(tmp_path / "mark")).awaitTermination()

    push(rows([(0.1, 10), (0.6, 10), (1.2, 10), (2.5, 1)]))
    push(rows([(2.6, 10), (3.5, 1), (0.2, 99)]))  # the last one is late for its closed window
    got = {(r.track, r.bin): r.cnt for r in SL.read_histogram(spark, ["track"], str(tmp_path / "hist")).collect()}
    mixed = 2000 + int(1000 * np.log10((1 + 100) / 2))
    assert got == {("t", 4000): 2, ("t", mixed): 1}


def test_ledger_stream(spark, tmp_path):
    rows = [("a", 1, 1, None, 2, False, 10, 20), ("a", 2, 2, None, 3, False, 11, 21), ("b", 1, 3, None, 1, False, None, None),
            ("a", 0, 4, None, -4, False, 1, 2), ("b", 5, 5, None, 7, False, 3, 4)]
    df = spark.createDataFrame(rows, "path string, ts int, id bigint, channel int, steps int, wrap boolean, min_gain int, max_gain int")
    df = df.withColumn("ts", F.timestamp_seconds("ts"))

    for part in (df.where("id < 4"), df.where("id >= 4")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        SLE.write_state(SLE.stream_ledger(stream), str(tmp_path / "state"), str(tmp_path / "mark")).awaitTermination()
    got = {r.path: (r.undo, r.entries, r.minmax) for r in SLE.read_state(spark, ["path"], str(tmp_path / "state")).collect()}
    want = {r.path: (r.left_undo, r.entries, r.minmax) for r in LE.ledger_state(df).collect()}
    assert got == want == {"a": (1, 3, "1,2"), "b": (8, 2, "3,4")}


def _tracks(spark, noise, tracks, ends=True):
    rows = [("al", t, i, 44100, "F32", [float(v) for v in noise[at:at + 1000]], None, ends and at + 1000 >= len(noise))
            for t in tracks for i, at in enumerate(range(0, len(noise), 1000))]
    return spark.createDataFrame(rows, "album string, track string, packet_no bigint, sample_rate int, format string, left array<double>, right array<double>, is_end boolean")


def test_a_marked_end_brings_out_the_last_window_and_clears_the_state(spark, tmp_path):
    noise = np.random.default_rng(2).normal(size=7000) * 0.1
    table = _tracks(spark, noise, ("a", "b"))
    table.where("packet_no < 4").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        with SF.state_store(spark):
            query = (SF.stream_filter(stream, ends="is_end").writeStream.format("parquet").option("path", str(tmp_path / "out"))
                     .option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start())
            query.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert run()[-1] == 2
    table.where("packet_no >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()[-1] == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = {(r.track, r.window_no): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.track, r.window_no): r for r in FI.filter_window_sums(O.packet_offsets(table)).collect()}
    assert set(got) == set(want) and {r.samples for r in got.values()} == {2205, 7000 % 2205}
    assert all(got[k].sum_squares == pytest.approx(want[k].sum_squares, rel=1e-9) and got[k].peak == want[k].peak for k in want)


def test_a_silent_track_ends_by_the_clock(spark, tmp_path):
    import time

    noise = np.random.default_rng(3).normal(size=3000) * 0.1
    table = _tracks(spark, noise, ("a",), ends=False)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    with SF.state_store(spark):
        query = (SF.stream_filter(stream, idle_seconds=2).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start())
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(1)
            out = [r for r in spark.read.schema("window_no bigint, samples bigint").parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").exists() else []
            if len(out) == 2:
                break
        query.stop()
    assert sorted((r.window_no, r.samples) for r in out) == [(0, 2205), (1, 795)]
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1] == 0


def test_a_hundred_batches_leave_few_folders(spark, tmp_path):
    keys, target = ["track"], str(tmp_path / "hist")
    table = SL.histogram_table(spark, keys, target, every=10)
    for i in range(100):
        rows = spark.createDataFrame([("t", i % 4, 1, float(i))], "track string, bin int, cnt long, peak double").coalesce(1)
        table.add(rows, i, writer="x")
    table.add(rows, 99, writer="x")
    assert len(table.manifest().folders) <= 11
    got = {r.bin: (r.cnt, r.peak) for r in SL.read_histogram(spark, keys, target).collect()}
    assert got == {b: (25, 96.0 + b) for b in range(4)}


@pytest.mark.parametrize("name", ["stream_filter", "stream_filter_ends", "incremental_catalog"])
def test_tables_in_folders_of_files_are_streamed(spark, tmp_path, name):
    for table in ("embeddings", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, want = (sorted(QUERIES[name](spark, d).collect()) for d in (str(tmp_path), "/root/testdata/sf0.001"))
    assert got == want and got
