import json
import re

import pytest
from pyspark.sql import functions as F

from loudframe import schemas
from loudframe.functions import tags as T
from loudframe.operators import ledger as LE
from loudframe.operators import tagtables as TT
from loudframe.plans import gain_plan as GP
from loudframe.plans import reports as RP
from loudframe.sources import sinks as SK


def gains(spark):
    rows = [(p, f, gr, ch, 0, 0, (f * 40 + gr * 90 + ch * 7 + len(p)) % 256)
            for p in ("a", "bb") for f in range(7) for gr in range(2) for ch in range(2)]
    return spark.createDataFrame(rows, schemas.GAINS)


def requests(spark, **steps):
    return spark.createDataFrame(list(steps.items()), "path string, steps int")


def content(df):
    return sorted(map(tuple, df.select("path", "frame_no", "gr", "ch", "gain").collect()))


def test_exact_undo_restores_everything(spark):
    before = gains(spark)
    for options in ({}, {"wrap": True}, {"channel": 1}):
        plan = GP.plan_gain(before, requests(spark, a=200, bb=-120), **options)
        after = GP.apply_plan(before, plan)
        assert content(after) != content(before)
        assert content(GP.apply_plan(after, GP.undo_plan(plan))) == content(before)


def test_saturation_wrap_and_channels(spark):
    before = gains(spark)
    up = GP.apply_plan(before, GP.plan_gain(before, requests(spark, a=300)))
    assert {r.gain for r in up.where("path = 'a'").collect()} == {255}
    assert content(up.where("path = 'bb'")) == content(before.where("path = 'bb'"))
    there = GP.apply_plan(before, GP.plan_gain(before, requests(spark, a=77), wrap=True))
    back = GP.apply_plan(there, GP.plan_gain(there, requests(spark, a=-77), wrap=True))
    assert content(back) == content(before)
    left = GP.apply_plan(before, GP.plan_gain(before, requests(spark, a=1), channel=0))
    assert content(left.where("ch = 1")) == content(before.where("ch = 1"))
    assert GP.plan_gain(before, requests(spark, a=0)).count() == 0
    summary = GP.plan_summary(GP.plan_gain(before, requests(spark, a=1))).first()
    assert (summary.path, summary.frames, summary.fields) == ("a", 7, 28)


def test_channel_requests_reject_mono(spark):
    modes = spark.createDataFrame([("a", "Mono"), ("bb", "Stereo")], "path string, channel_mode string")
    usable, errors = GP.channel_requests(requests(spark, a=1, bb=2, c=3), modes)
    assert {r.path for r in usable.collect()} == {"bb", "c"}
    assert [(r.path, r.status, r.error) for r in errors.collect()] == [("a", "error", GP.MONO_ERROR)]


def ledger(spark, rows):
    full = [(p, ts, i, ch, st, w, lo, hi) for i, (p, ts, ch, st, w, lo, hi) in enumerate(rows)]
    df = spark.createDataFrame(full, "path string, ts int, id int, channel int, steps int, wrap boolean, min_gain int, max_gain int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("ts") * 40000))


def test_ledger(spark):
    rows = [("a", 1, None, 2, False, 10, 20), ("a", 2, 0, 3, False, 11, 21), ("a", 9, 1, -1, False, 1, 2),
            ("a", 20, None, 4, True, 5, 6), ("b", 1, 1, 5, False, None, None), ("b", 50, None, -5, False, 7, 8)]
    df = ledger(spark, rows)
    run = {r.id: (r.left_undo, r.right_undo) for r in LE.channel_ledger(df).collect()}
    assert run == {0: (2, 2), 1: (5, 2), 2: (5, 1), 3: (9, 5), 4: (0, 5), 5: (-5, 0)}
    # Storing only the left value makes a change of both channels overwrite the right one.
    compat = {r.id: (r.left_undo, r.right_undo) for r in LE.channel_ledger(df, compat=True).collect()}
    assert compat == {0: (2, 2), 1: (5, 2), 2: (5, 1), 3: (9, 9), 4: (0, 5), 5: (-5, -5)}
    assert {r.id: r.minmax for r in LE.first_minmax(df).collect()} == {0: "10,20", 1: "10,20", 2: "10,20", 3: "10,20", 4: None, 5: "7,8"}
    state = {r.path: r for r in LE.ledger_state(df).collect()}
    assert (state["a"].undo_tag, state["a"].minmax, state["a"].entries) == ("+009,+005,W", "10,20", 4)
    assert state["b"].undo_tag == "-005,+000,N"


def test_ledger_entries(spark):
    stats = spark.createDataFrame([("a", 1, 2)], "path string, min_gain int, max_gain int")
    args = (requests(spark, a=3, b=0), stats, F.lit("2024-01-01").cast("timestamp"), F.lit(1))
    assert [(r.path, r.steps, r.min_gain) for r in GP.ledger_entries(*args).collect()] == [("a", 3, 1)]
    assert GP.ledger_entries(*args, record=False).count() == 0


def test_undo_requests(spark):
    files = spark.createDataFrame([("none",), ("bad",), ("zero",), ("ok",)], "path string")
    texts = spark.createDataFrame([("bad", "x,1,N"), ("zero", "+000,+000,N"), ("ok", "+003,+003,N")], "path string, t string")
    undo = texts.select("path", F.lit(True).alias("has_tag"), T.undo_steps(F.col("t")).alias("undo"))
    got = {r.path: (r.status, r.steps, r.error) for r in GP.undo_requests(files, undo).collect()}
    assert got == {"none": ("error", None, GP.NO_TAG_ERROR), "bad": ("error", None, GP.NO_UNDO_ERROR),
                   "zero": ("skipped", 0, None), "ok": ("success", -3, None)}


def test_parse_undo_texts(spark):
    cases = {"": (0, 0), "+002": (2, 2), "x,+003,N": (0, 3), "+002,-003,W": (2, -3), " 4 , y": (4, 4), "99999999999": (0, 0)}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.parse_undo(F.col("t")).alias("u"))
    assert {r.t: tuple(r.u) for r in df.collect()} == cases


def tag_table(spark):
    rows = [("a", "n", 0, "Title", "x"), ("a", "n", 1, "replaygain_track_gain", "old"), ("a", "n", 2, "ReplayGain_Album_Gain", "old"),
            ("b", "n", 0, "REPLAYGAIN_TRACK_GAIN", "keep")]
    return spark.createDataFrame(rows, schemas.TAGS)


def test_merging_tags(spark):
    new = spark.createDataFrame([("a", "n", 0, "REPLAYGAIN_TRACK_GAIN", "new")], schemas.TAGS)
    pairs = lambda df: sorted((r.path, r.key, r.value) for r in df.collect())
    assert pairs(TT.merge_tag_rows(tag_table(spark), new)) == [
        ("a", "REPLAYGAIN_TRACK_GAIN", "new"), ("a", "Title", "x"), ("b", "REPLAYGAIN_TRACK_GAIN", "keep")]
    kept = pairs(TT.merge_tag_rows(tag_table(spark), new, keep_missing=True))
    assert ("a", "ReplayGain_Album_Gain", "old") in kept and len(kept) == 4
    files = spark.createDataFrame([("a",), ("c",)], "path string")
    assert pairs(TT.delete_tags(tag_table(spark), files)) == [("b", "REPLAYGAIN_TRACK_GAIN", "keep")]
    assert {r.path: r.removed for r in TT.delete_report(files, tag_table(spark)).collect()} == {"a": 3, "c": 0}


def test_level_tags(spark):
    rows = spark.createDataFrame([(3.5, 0.98765, 2.0, 0.99999)], "g double, p double, ag double, ap double")
    items = rows.select(T.level_tags(F.col("g"), F.col("p"), F.col("ag"), F.col("ap")).alias("t")).first().t
    assert [i.value for i in items] == ["+3.50 dB", "0.987650", "+2.00 dB", "0.999990"]


def test_reports_and_sinks(spark, tmp_path):
    rows = [("d/a.mp3", "mp3", 70.0, -5.18, 0.5, 10, None), ("d/b.m4a", "mp4", 60.0, 4.82, 0.9, None, None),
            ("d/c.mp3", "mp3", 64.8, 0.02, 0.9, 10, None), ("d/d.mp3", "mp3", None, None, None, None, "broken")]
    tracks = spark.createDataFrame(rows, "file string, kind string, loudness_db double, gain_db double, peak double, frames int, error string")
    got = {r.file: r for r in RP.track_gain_report(tracks).collect()}
    assert [got[f].status for f in ("d/a.mp3", "d/b.m4a", "d/c.mp3", "d/d.mp3")] == ["success", "success", "skipped", "error"]
    assert (got["d/a.mp3"].gain_applied_steps, got["d/a.mp3"].gain_applied_db, got["d/a.mp3"].frames) == (-3, -4.5, 10)
    assert (got["d/b.m4a"].gain_applied_steps, got["d/b.m4a"].gain_applied_db, got["d/b.m4a"].frames) == (3, 4.82, None)
    assert got["d/b.m4a"].warning.startswith("clipping warning: peak would be 1.51")
    dry = {r.file: r for r in RP.track_gain_report(tracks, dry_run=True, prevent=True).collect()}
    assert (dry["d/b.m4a"].status, dry["d/b.m4a"].gain_applied_steps, dry["d/b.m4a"].dry_run) == ("dry_run", 0, True)
    report = RP.track_gain_report(tracks)
    summary = RP.batch_summary(report).first()
    assert (summary.total_files, summary.successful, summary.failed, summary.dry_run) == (4, 2, 1, None)

    document = json.loads(SK.json_document(report, RP.batch_summary(report)).first().value)
    assert [f["file"] for f in document["files"]] == ["d/a.mp3", "d/b.m4a", "d/c.mp3", "d/d.mp3"]
    assert document["files"][3] == {"file": "d/d.mp3", "status": "error", "error": "broken"}
    assert document["summary"] == {"total_files": 4, "successful": 2, "failed": 1}
    SK.write_json(report, str(tmp_path / "json"), summary=RP.batch_summary(report))
    assert spark.read.json(str(tmp_path / "json" / "files")).count() == 4

    silent = spark.createDataFrame([("s", "mp3", 0.0, 1, 2, None)], "file string, kind string, peak double, min_gain int, max_gain int, error string")
    peaks = RP.max_amplitude_report(silent)
    assert peaks.first().headroom_db == float("inf")
    assert "headroom_db" not in json.loads(SK.json_rows(peaks).first().value)

    level = tracks.where("error IS NULL").withColumns({"max_gain": F.lit(200), "min_gain": F.lit(None).cast("int")})
    SK.write_tsv(SK.level_rows(level.orderBy("file").coalesce(1), modifier_db=1.5), str(tmp_path / "tsv"))
    lines = next((tmp_path / "tsv").glob("part-*")).read_text().splitlines()
    assert lines[0].split("\t") == list(SK.TSV_COLUMNS)
    assert lines[1].split("\t") == ["a.mp3", "-2", "-3.680000", "16384.000000", "200", "-"]


def test_album_report(spark):
    rows = [("x", "d/a.mp3", "mp3", 70.0, -5.0, 0.5, 10, None), ("y", "d/b.mp3", "mp3", 60.0, 4.8, 0.9, 8, None)]
    tracks = spark.createDataFrame(rows, "album string, file string, kind string, loudness_db double, gain_db double, peak double, frames int, error string")
    albums = spark.createDataFrame([("x", 9.0)], "album string, album_gain_db double")
    got = {r.file: r for r in RP.album_gain_report(tracks, albums, prevent=True).collect()}
    assert (got["d/a.mp3"].status, got["d/a.mp3"].gain_applied_steps) == ("success", 4)
    assert (got["d/b.mp3"].status, got["d/b.mp3"].error) == ("error", "Failed to analyze album")


@pytest.mark.parametrize("wrap", [False, True])
def test_requests_applied_in_the_row_give_the_plan_applied(spark, wrap):
    before, wanted = gains(spark), requests(spark, a=200, bb=0, c=3)
    after = GP.apply_requests(before, wanted, wrap=wrap)
    assert after.columns == before.columns and content(after) == content(GP.apply_plan(before, GP.plan_gain(before, wanted, wrap=wrap)))
    twice = before.union(before)  # fields that share a place are patched each
    assert content(GP.apply_requests(twice, wanted, wrap=wrap)) == sorted(2 * content(after))
    assert "frame_no" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", after._jdf.queryExecution().executedPlan().toString()))
