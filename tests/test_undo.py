"""Epochs of the ledger, undo, and appends that count once."""

import random

import pytest
from pyspark.sql import functions as F

from loudframe.operators import ledger as LE
from loudframe.operators.histogram import merge_histograms
from loudframe.plans import gain_plan as GP
from loudframe.streaming.store import MergedTable

SCHEMA = "path string, ts timestamp, id long, channel int, steps int, wrap boolean, min_gain int, max_gain int, event string"


def entries(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        path = rng.choice(("hot", "hot", "b", None))
        rows.append((path, i // 3 * 40000, i, rng.choice((None, 0, 1)), rng.randrange(-5, 6), False, *((None, None) if i % 3 else (i % 50, i % 50 + 9)),
                     rng.choice(("apply", None, "apply", "undo")) if i % 7 == 0 else "apply"))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], SCHEMA).withColumn(
        "ts", F.timestamp_seconds(F.col("id").cast("long") - F.col("id") % 3)) if rows else spark.createDataFrame([], SCHEMA)


def test_epochs_against_a_plain_loop(spark):
    rows = entries()
    got = {r.id: (r.epoch, r.left_undo, r.right_undo, r.minmax) for r in LE.epoch_ledger(table(spark, rows).repartition(3)).collect()}
    state = {}
    for r in rows:
        epoch, left, right, span = state.get(r[0], (0, 0, 0, None))
        if r[8] == "undo":
            epoch, left, right, span = epoch + 1, 0, 0, None
        else:
            left += r[4] if r[3] in (None, 0) else 0
            right += r[4] if r[3] in (None, 1) else 0
            span = span or (f"{r[6]},{r[7]}" if r[6] is not None else None)
        state[r[0]] = epoch, left, right, span
        assert got[r[2]] == state[r[0]], r
    now = {r.path: (r.left_undo, r.right_undo, r.minmax) for r in LE.ledger_state(LE.current_entries(table(spark, rows))).collect()}
    last = {r[0]: r[8] for r in rows}  # after an undo nothing is left
    assert now == {p: s[1:] for p, s in state.items() if last[p] != "undo"} and len(now) >= 2


def test_undo_runs_once(spark):
    files = spark.createDataFrame([(p,) for p in ("a", "zero", "none", "tags", "frameless")], "path string")
    rows = [("a", 1, 1, None, 3, False, 10, 20, "apply"), ("a", 2, 2, 0, 2, False, 11, 22, "apply"), ("zero", 1, 3, None, 4, False, None, None, None),
            ("zero", 2, 4, None, -4, False, None, None, "apply"), ("frameless", 1, 5, None, 1, False, None, None, "apply")]
    ledger, stats = table(spark, rows), spark.createDataFrame([("a", 7), ("zero", 8)], "path string, frames long")
    tagged = spark.createDataFrame([("tags",)], "path string")
    report, requests, new = GP.undo_run(files, ledger, stats, F.timestamp_seconds(F.lit(100)), F.lit(100), tagged=tagged)
    assert {r.file: (r.status, r.frames, r.error) for r in report.collect()} == {
        "a": ("success", 7, None), "zero": ("skipped", 0, None), "none": ("error", None, GP.NO_TAG_ERROR), "tags": ("error", None, GP.NO_UNDO_ERROR),
        "frameless": ("error", None, "No valid MP3 frames found")}
    assert [(r.path, r.steps) for r in requests.collect()] == [("a", -5)]
    after = ledger.unionByName(new)
    report, requests, _ = GP.undo_run(files, after, stats, F.timestamp_seconds(F.lit(200)), F.lit(200))
    assert {r.file: r.status for r in report.collect()}["a"] == "error" and requests.count() == 0
    again = after.unionByName(table(spark, [("a", 300, 300, None, 1, False, 50, 60, "apply")]))
    state = {r.path: r for r in LE.ledger_state(LE.current_entries(again)).collect()}
    assert (state["a"].left_undo, state["a"].minmax) == (1, "50,60") and state["zero"].left_undo == 0


def test_dry_undo_changes_nothing(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    report, requests, new = GP.undo_run(files, table(spark, []), spark.createDataFrame([], "path string, frames long"), F.current_timestamp(), F.lit(1), dry_run=True)
    assert {(r.file, r.status, r.dry_run) for r in report.collect()} == {("a", "dry_run", True), ("b", "dry_run", True)}
    assert requests.count() == new.count() == 0


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    rows, target = table(spark, entries()[:20]), str(tmp_path / "ledger")
    assert GP.append_ledger(rows, target, 0) and not GP.append_ledger(rows, target, 0)
    assert GP.append_ledger(rows, target, 0, writer="other") and GP.append_ledger(rows, target, 5)
    assert not GP.append_ledger(rows, target, 4)
    assert GP.read_ledger(spark, target).count() == 60


def test_reads_open_few_folders_after_many_batches(spark, tmp_path):
    table_ = MergedTable(spark, str(tmp_path / "t"), lambda rows: merge_histograms(rows, ["k"]), every=4)
    with pytest.raises(ValueError):
        table_.read()
    for i in range(30):
        batch = spark.createDataFrame([("a", 1, 1), ("b", i % 3, 2)], "k string, bin int, cnt long").coalesce(1)
        for _ in range(1 + (i % 5 == 0)):
            table_.add(batch, i)
        assert len(table_.manifest().folders) <= 5
    got = {(r.k, r.bin): r.cnt for r in table_.read().collect()}
    assert got == {("a", 1): 30, ("b", 0): 20, ("b", 1): 20, ("b", 2): 20}
    folders = [p.name for p in (tmp_path / "t").iterdir()]
    assert len(folders) < 14 and len(list((tmp_path / "t" / "_manifest").glob("[0-9]*"))) <= 2


def test_folders_without_a_manifest_do_not_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1)], "k string, bin int, cnt long")
    table_ = MergedTable(spark, str(tmp_path / "t"), lambda r: merge_histograms(r, ["k"]))
    table_.add(rows, 0)
    rows.write.parquet(str(tmp_path / "t" / "delta-of-an-attempt-that-died"))
    assert table_.read().collect()[0].cnt == 1
    other = MergedTable(spark, str(tmp_path / "t"), lambda r: merge_histograms(r, ["k"]))
    stale = other.manifest()
    table_.add(rows, 1)
    other.manifest = lambda: stale  # a second writer that has not seen batch 1
    with pytest.raises(RuntimeError):
        other.add(rows, 7)
