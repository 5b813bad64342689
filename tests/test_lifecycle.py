"""Whole jobs: a directory of files to a report, packets to applied album gain, apply and undo."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import test_files as made
from loudframe import schemas
from loudframe.functions import headers as H
from loudframe.operators import filtering as FI
from loudframe.operators import frames as FR
from loudframe.operators import ledger as LE
from loudframe.operators import loudness as LO
from loudframe.operators import ordered as O
from loudframe.operators import tagtables as TT
from loudframe.plans import gain_plan as GP
from loudframe.plans import reports as RP
from loudframe.sources import catalog as CA
from loudframe.sources import files as FS
from loudframe.sources import sinks as SK


def write_files(root):
    (root / "sub").mkdir()
    contents = {
        "a.mp3": made.id3v2(50) + made.info_frame() + made.frame([100, 110, 120, 130]) * 3,
        "sub/b.MP3": made.frame([50, 60], mode=3) * 2 + made.ape([(b"mp3gain_undo", b"+002,+002,N"), (b"Title", b"t")]),
        "sub/c.m4a": made.box(b"ftyp", b"M4A \0\0\0\0isom") + made.box(b"mdat", bytes(40)),
        "sub/d.mp3": b"not audio at all",
        "notes.txt": made.frame([1, 2, 3, 4]),
    }
    for name, data in contents.items():
        (root / name).write_bytes(data)


def test_directory_to_info_and_tag_report(spark, tmp_path):
    write_files(tmp_path)
    files = CA.catalog_filter(CA.read_files(spark, str(tmp_path)), extensions=("mp3", "m4a", "aac", "mp4"))
    kinds = files.select("path", H.sniff_kind(F.col("content")).alias("kind"))
    report = RP.info_report(kinds, FR.frame_stats(FS.frame_rows(files)))
    rows = {r.file.rsplit("/", 1)[1]: r for r in report.collect()}
    assert set(rows) == {"a.mp3", "b.MP3", "c.m4a", "d.mp3"}
    a = rows["a.mp3"]
    assert (a.frames, a.mpeg_version, a.channel_mode, a.min_gain, a.max_gain, a.avg_gain) == (3, "MPEG1", "Stereo", 100, 130, 115.0)
    assert (a.headroom_steps, a.headroom_db, a.status) == (125, 187.5, None)
    assert (rows["b.MP3"].frames, rows["b.MP3"].channel_mode) == (2, "Mono")
    assert (rows["c.m4a"].status, rows["c.m4a"].frames) == ("info", None)
    assert (rows["d.mp3"].status, rows["d.mp3"].error) == ("error", "No valid MP3 frames found")
    summary = json.loads(SK.json_document(report, RP.batch_summary(report)).first().value)["summary"]
    assert summary == {"total_files": 4, "successful": 0, "failed": 1}

    columns = TT.tag_columns(FS.ape_tag_rows(files))
    tags = {r.file.rsplit("/", 1)[1]: r for r in RP.tag_report(TT.join_tags(files.select("path"), columns)).collect()}
    assert (tags["b.MP3"].status, tags["b.MP3"].mp3gain_undo, tags["b.MP3"].mp3gain_minmax) == ("success", "+002,+002,N", "-")
    assert tags["a.mp3"].status == "no_tag"


def test_packets_to_album_gain_plan_ledger_and_undo(spark):
    rate, t = 44100, np.arange(44100) / 44100
    rows = []
    for track, amp in (("loud", 0.5), ("soft", 0.1)):
        x = amp * np.sin(2 * np.pi * 1000 * t)
        rows += [("al", track, i, rate, "F32", [float(v) for v in x[at:at + 1152]], None) for i, at in enumerate(range(0, rate, 1152))]
    windows = FI.filter_window_sums(O.packet_offsets(spark.createDataFrame(rows, schemas.PACKETS)))
    tracks, albums = LO.level_tables(windows, ["album", "track"], ["album"])
    # The loud track fills the upper half of the album's windows, so the album is as loud.
    album = albums.first()
    assert album.album_loudness_db == pytest.approx(72.97) and album.album_gain_db == pytest.approx(64.82 - 72.97)
    assert album.album_gain_steps == -5 and album.album_peak == pytest.approx(0.5, rel=1e-4)

    gains = spark.createDataFrame(
        [(f"{p}.mp3", f, g, c, 0, 0, 3 + 40 * f + 7 * c) for p in ("loud", "soft") for f in range(5) for g in range(2) for c in range(2)],
        schemas.GAINS)
    stats = FR.gain_stats(gains)
    assert {r.path: r.frames for r in stats.collect()} == {"loud.mp3": 5, "soft.mp3": 5}
    files = tracks.withColumns({"file": F.concat("track", F.lit(".mp3")), "kind": F.lit("mp3"), "error": F.lit(None).cast("string"),
                                "frames": F.lit(5)})
    report = RP.album_gain_report(files, albums)
    assert {(r.file, r.status, r.gain_applied_steps, r.gain_applied_db) for r in report.collect()} == {
        ("loud.mp3", "success", -5, -7.5), ("soft.mp3", "success", -5, -7.5)}

    requests = report.select(F.col("file").alias("path"), F.col("gain_applied_steps").alias("steps"))
    plan = GP.plan_gain(gains, requests)
    after = GP.apply_plan(gains, plan)
    key = lambda df: sorted(map(tuple, df.select("path", "frame_no", "gr", "ch", "gain").collect()))
    assert {r.gain for r in after.where("frame_no = 0 and ch = 0").collect()} == {0}  # saturated
    assert {r.path: (r.frames, r.changed) for r in GP.plan_summary(plan).collect()} == {"loud.mp3": (5, 20), "soft.mp3": (5, 20)}
    entries = GP.ledger_entries(requests, stats, F.lit("2024-01-01").cast("timestamp"), F.lit(1))
    assert {r.undo_tag for r in LE.ledger_state(entries).collect()} == {"-005,-005,N"}
    assert key(GP.apply_plan(after, GP.undo_plan(plan))) == key(gains)  # exact in spite of saturation
    # Undo by the stored value is not exact once a field was saturated.
    stored = LE.ledger_state(entries).select("path", F.lit(True).alias("has_tag"), F.col("left_undo").cast("int").alias("undo"))
    back = GP.apply_plan(after, GP.plan_gain(after, GP.undo_requests(requests.select("path"), stored)))
    assert key(back) != key(gains) and {r.gain for r in back.where("frame_no = 0 and ch = 0").collect()} == {5}
