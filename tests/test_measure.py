"""Packets to levels or errors, and the request table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loudframe import schemas
from loudframe.operators import filtering as FI
from loudframe.operators import loudness as LO
from loudframe.operators import measure as M
from loudframe.operators import ordered as O
from loudframe.operators import windows as W
from loudframe.plans import apply as AP


def packet_rows(album, track, rate, x, size=1000, changes=None):
    return [(album, track, i, changes if changes and i % 2 else rate, "F32", [float(v) for v in x[at:at + size]], None)
            for i, at in enumerate(range(0, len(x), size))]


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(4).normal(size=12000) * 0.1


@pytest.fixture(scope="module")
def packets(spark, noise):
    rows = packet_rows("al", "a", 44100, noise) + packet_rows("al", "b", 48000, noise) + packet_rows(None, "a", 32000, noise)
    rows += packet_rows("mix", "turns", 44100, noise, changes=48000) + packet_rows("mix", "fine", 44100, noise)
    rows += packet_rows("bad", "rate", 88200, noise) + packet_rows("odd", "rate", 0, noise) + packet_rows("odd", None, None, noise)
    rows += [("quiet", "empty", 0, 44100, "F32", [], None), ("quiet", "lost", 0, 44100, "F32", None, None)]
    return O.packet_offsets(spark.createDataFrame(rows, schemas.PACKETS).repartition(3).where("left IS NOT NULL")).unionByName(
        spark.createDataFrame([r for r in rows if r[5] is None], schemas.PACKETS).withColumn("first_sample", F.lit(0).cast("long")))


def test_every_track_has_one_row_with_a_level_or_an_error(spark, packets):
    catalog = packets.select("album", "track").distinct().union(spark.createDataFrame([("gone", "gone"), (None, "a")], "album string, track string"))
    tracks, albums = M.measure(packets, catalog=catalog)
    got = {(r.album, r.track): r for r in tracks.collect()}
    errors = {k: r.error for k, r in got.items() if r.error}
    assert errors == {("mix", "turns"): "Sample rate changes inside the track: 44100 to 48000 Hz", ("bad", "rate"): "Unsupported sample rate: 88200 Hz",
                      ("odd", "rate"): "Unsupported sample rate: 0 Hz", ("odd", None): "Unknown sample rate", ("gone", "gone"): "No audio track found"}
    assert len(got) == 11 and all(got[k].loudness_db is None and got[k].peak is None for k in errors)
    assert all((got["quiet", t].loudness_db, got["quiet", t].windows, got["quiet", t].peak, got["quiet", t].samples) == (-20.0, 0, 0.0, 0) for t in ("empty", "lost"))
    plain = {(r.album, r.track): r for r in LO.track_loudness(FI.filter_window_sums(packets.where("album = 'al' OR album IS NULL")), ["album", "track"]).collect()}
    assert len(plain) == 3
    for k, r in plain.items():
        assert (got[k].loudness_db, got[k].windows, got[k].gain_steps, got[k].peak) == (r.loudness_db, r.windows, r.gain_steps, r.peak)
    rows = {r.album: r for r in albums.collect()}
    assert {k: (r.tracks, r.failed, r.album_loudness_db is None) for k, r in rows.items()} == {
        "al": (2, 0, False), None: (1, 0, False), "mix": (2, 1, True), "bad": (1, 1, True), "odd": (2, 2, True), "quiet": (2, 0, False), "gone": (1, 1, True)}
    assert rows[None].album_loudness_db == got[None, "a"].loudness_db and rows["quiet"].album_loudness_db == -20.0


def test_permissive_albums_leave_failed_tracks_out(packets):
    tracks, albums = M.measure(packets, mode="permissive")
    fine = next(r for r in tracks.collect() if r.track == "fine")
    mix = next(r for r in albums.collect() if r.album == "mix")
    assert (mix.album_loudness_db, mix.album_peak, mix.windows) == (fine.loudness_db, fine.peak, fine.windows)
    with pytest.raises(ValueError):
        M.measure(packets, mode="other")


def test_no_packets(packets):
    tracks, albums = M.measure(packets.limit(0))
    assert tracks.count() == 0 and albums.count() == 0


def test_packet_sums_are_the_sample_sums(spark, packets, noise):
    stereo = [("st", "x", i, 44100, "S16", [float(v) for v in noise[at:at + 7000] * 9000], [float(v) for v in noise[::-1][at:at + 7000] * 9000])
              for i, at in enumerate(range(0, 12000, 7000))]
    both = packets.where("left IS NOT NULL AND sample_rate > 0").unionByName(O.packet_offsets(spark.createDataFrame(stereo, schemas.PACKETS)))
    keys = ["album", "track", "window_no"]
    slow = W.window_sums(W.explode_packets(both), ["album", "track"], F.col("n"), (F.col("sample_rate") * 50 / 1000).cast("long"), F.col("left"), F.col("right"))
    got = {tuple(r[k] for k in keys): r for r in W.packet_window_sums(both).collect()}
    want = {tuple(r[k] for k in keys): r for r in slow.collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k].samples == r.samples and got[k].sum_squares == pytest.approx(r.sum_squares, rel=1e-9) and got[k].peak == pytest.approx(r.peak, rel=1e-12)


def requests(spark, **options):
    rows = [("1", "a.mp3", "mp3", 70.0, 64.82 - 70, 0.5, None), ("1", "b.m4a", "mp4", 60.0, 4.82, 0.9, None), ("1", "c.mp3", "mp3", 64.82, 0.0, 0.1, None),
            (None, "d.mp3", "mp3", 50.0, 14.82, 0.9, None), (None, "e.mp3", "mp3", 50.0, 14.82, 0.1, None), ("2", "f.mp3", "mp3", None, None, None, "broken"),
            ("2", "g.mp3", "mp3", 60.0, 4.82, 0.1, None)]
    tracks = spark.createDataFrame(rows, "album string, path string, kind string, loudness_db double, gain_db double, peak double, error string")
    stats = spark.createDataFrame([(p, 10, 100, 200) for p in ("a.mp3", "c.mp3", "d.mp3", "f.mp3", "g.mp3")], "path string, frames long, min_gain int, max_gain int")
    albums = spark.createDataFrame([("1", 3.0, 0.9), (None, 14.82, 0.9), ("2", None, None)], "album string, album_gain_db double, album_peak double")
    use = albums if options.pop("by_album", False) else None
    return AP.gain_requests(tracks, stats, use, **options)


def test_outputs_of_one_request_table_agree(spark):
    asked = requests(spark, prevent=True)
    report = {r.file: r for r in AP.report(asked).collect()}
    assert {k: (r.status, r.gain_applied_steps, r.frames) for k, r in report.items()} == {
        "a.mp3": ("success", -3, 10), "b.m4a": ("success", 3, None), "c.mp3": ("skipped", 0, None), "d.mp3": ("success", 0, None), "e.mp3": ("error", None, None),
        "f.mp3": ("error", None, None), "g.mp3": ("success", 3, 10)}
    assert report["e.mp3"].error == "No valid MP3 frames found" and report["f.mp3"].error == "broken"
    assert report["d.mp3"].warning.startswith("gain reduced from 10 to 0 steps")
    gains = spark.createDataFrame([(p, 0, 0, c, 100) for p in report for c in (0, 1)], "path string, frame_no long, gr int, ch int, gain int")
    assert {(r.path, r.old, r.new) for r in AP.patches(asked, gains).collect()} == {("a.mp3", 100, 97), ("g.mp3", 100, 103)}
    entries = AP.ledger_rows(asked, F.current_timestamp(), F.lit(1))
    assert {(r.path, r.steps, r.min_gain) for r in entries.collect()} == {("a.mp3", -3, 100), ("g.mp3", 3, 100)}
    before = spark.createDataFrame([("a.mp3", 2, 4, "90,210")], "path string, left_undo long, right_undo long, minmax string")
    tags = {(r.path, r.key): r.value for r in AP.tag_rows(asked, before).collect()}
    assert tags == {("a.mp3", "MP3GAIN_UNDO"): "-001,+001,N", ("a.mp3", "MP3GAIN_MINMAX"): "90,210", ("g.mp3", "MP3GAIN_UNDO"): "+003,+003,N",
                    ("g.mp3", "MP3GAIN_MINMAX"): "100,200", ("b.m4a", "REPLAYGAIN_TRACK_GAIN"): "+4.82 dB", ("b.m4a", "REPLAYGAIN_TRACK_PEAK"): "0.900000"}


def test_album_requests_and_dry_runs(spark):
    rows = {r.file: r for r in AP.report(requests(spark, by_album=True)).collect()}
    assert rows["a.mp3"].gain_applied_steps == 2 and rows["g.mp3"].error == "Failed to analyze album" and rows["f.mp3"].error == "broken"
    asked = requests(spark, by_album=True, dry_run=True)
    rows = {r.file: r.status for r in AP.report(asked).collect()}
    assert rows["a.mp3"] == "dry_run" and rows["f.mp3"] == "error"
    gains = spark.createDataFrame([("a.mp3", 0, 0, 0, 100)], "path string, frame_no long, gr int, ch int, gain int")
    assert AP.patches(asked, gains).count() == AP.tag_rows(asked).count() == AP.ledger_rows(asked, F.current_timestamp(), F.lit(1)).count() == 0
