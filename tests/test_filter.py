import os
import subprocess
import sys

import numpy as np
import pytest

from loudframe import constants as C
from loudframe import schemas
from loudframe.operators import filtering as FI
from loudframe.operators import loudness as LO
from loudframe.operators import ordered as O
from loudframe.operators import windows as W
from pyspark.sql import functions as F


def one_by_one(x, rate):
    """The two recursions written out sample by sample."""
    a, b = C.SHAPING_FILTERS[rate]
    d, c = C.high_pass_weights(rate)
    xs, ys, us, zs, out = [0.0] * 10, [0.0] * 10, [0.0] * 2, [0.0] * 2, []
    for v in x:
        y = 1e-10 + b[0] * v + sum(b[i + 1] * xs[i] - a[i] * ys[i] for i in range(10))
        z = 1e-10 + c[0] * y + sum(c[i + 1] * us[i] - d[i] * zs[i] for i in range(2))
        xs, ys, us, zs = [v, *xs[:-1]], [y, *ys[:-1]], [y, us[0]], [z, zs[0]]
        out.append(z)
    return np.array(out)


def packets(spark, tracks, size=1152):
    rows = []
    for name, (rate, kind, left, right) in tracks.items():
        for i, at in enumerate(range(0, len(left), size)):
            cut = lambda s: None if s is None else [float(v) for v in s[at:at + size]]
            rows.append(("album", name, i, rate, kind, cut(left), cut(right)))
    return spark.createDataFrame(rows, schemas.PACKETS).repartition(5)


def tracks_of(spark, made, chunk=FI.DEFAULT_CHUNK):
    placed = O.packet_offsets(packets(spark, made))
    rows = LO.track_loudness(FI.filter_window_sums(placed, chunk=chunk), ["album", "track"]).collect()
    return {r.track: r for r in rows}


@pytest.mark.parametrize("rate", list(C.SHAPING_FILTERS))
def test_matrix_form_equals_the_recursion(rate):
    x = np.random.default_rng(rate).normal(size=9000) * 3000
    want = one_by_one(x, rate)
    got, _ = FI.run_filter(rate).apply(x)
    assert np.abs(got - want).max() < 1e-9 * np.abs(want).max()
    # The state carries over any cut, and fades out within the warm-up.
    first, state = FI.run_filter(rate).apply(x[:1001])
    second, _ = FI.run_filter(rate).apply(x[1001:], state)
    assert np.abs(np.concatenate([first, second]) - want).max() < 1e-9 * np.abs(want).max()
    warm = FI.warmup_samples(rate)
    tail, _ = FI.run_filter(rate).apply(x[8500 - warm:])
    assert np.abs(tail[warm:] - want[8500:]).max() < 1e-9 * np.abs(want).max()


def test_published_sine_levels(spark):
    golden = {(44100, 0.5): 72.97, (44100, 0.1): 58.99, (48000, 0.5): 72.96, (48000, 0.1): 58.98, (8000, 0.5): 71.53,
              (8000, 0.1): 57.55, (96000, 0.5): 74.08, (96000, 0.1): 60.10}
    made = {f"{r}/{a}": (r, "F32", a * np.sin(2 * np.pi * 1000 * np.arange(r) / r), None) for r, a in golden}
    made["silence"] = (44100, "S16", np.zeros(44100), None)
    for chunk in (FI.DEFAULT_CHUNK, 8192):
        got = tracks_of(spark, made, chunk)
        for (r, a), level in golden.items():
            row = got[f"{r}/{a}"]
            assert row.loudness_db == pytest.approx(level, abs=1e-9) and row.windows == 20
            assert row.peak == pytest.approx(a, rel=1e-4)
        assert (got["silence"].loudness_db, got["silence"].windows) == (-20.0, 0)
        assert got["silence"].gain_db == pytest.approx(84.82)


def test_chunks_and_channels(spark):
    rng = np.random.default_rng(8)
    left, right = rng.normal(size=30000) * 0.1, rng.normal(size=30000) * 0.05
    made = {"stereo": (44100, "F32", left, right), "same": (44100, "F32", left, left), "mono": (44100, "F32", left, None)}
    placed = O.packet_offsets(packets(spark, made))
    rows = FI.equal_loudness_filter(placed, chunk=8192).where("track = 'stereo'").orderBy("packet_no").collect()
    want_left, want_right = one_by_one(left * 32768, 44100), one_by_one(right * 32768, 44100)
    assert np.allclose(np.concatenate([r.left for r in rows]), want_left, rtol=0, atol=1e-8)
    assert np.allclose(np.concatenate([r.right for r in rows]), want_right, rtol=0, atol=1e-8)
    small = {(r.track, r.window_no): r for r in FI.filter_window_sums(placed, chunk=8192).collect()}
    for n in range(14):
        part = slice(n * 2205, (n + 1) * 2205)
        want = (want_left[part] ** 2 + want_right[part] ** 2).sum()
        assert small["stereo", n].sum_squares == pytest.approx(want, rel=1e-9)
        assert small["stereo", n].samples == len(want_left[part])
        # A mono track counts twice, so it equals the duplicated stereo track.
        assert small["mono", n].sum_squares == pytest.approx(small["same", n].sum_squares, rel=1e-12)


@pytest.mark.parametrize("gap,fits", [(None, True), ((3, 20), True), ((64, 70), False), ((45, 85), False)])
def test_chunks_by_packet_number_equal_chunks_by_position(spark, gap, fits, monkeypatch):
    """Blocks of 40 packets that lend 16, with gaps; the last two leave too little to lend."""
    monkeypatch.setattr(FI, "PACKET_SAMPLES", 200)
    rng = np.random.default_rng(11)
    made = {t: (44100, "F32", rng.normal(size=20000) * 0.1, None) for t in ("a", "b")}
    rows = packets(spark, made, size=200).withColumn("samples", F.size("left"))
    if gap is not None:
        rows = rows.where(f"track = 'b' OR packet_no NOT BETWEEN {gap[0]} AND {gap[1]}")
    blocked = FI._blocked(rows, ["album", "track"], 40)
    assert (blocked is not None) == fits
    want = {(r.track, r.window_no): r for r in FI.filter_window_sums(O.packet_offsets(rows)).collect()}
    got = {(r.track, r.window_no): r for r in FI.filter_window_sums(rows, chunk=8000).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k].samples == r.samples and got[k].sum_squares == pytest.approx(r.sum_squares, rel=1e-9)
    one = FI.equal_loudness_filter(rows, chunk=8000).select("track", "packet_no", "first_sample", F.size("left").alias("n"))
    two = O.packet_offsets(rows).select("track", "packet_no", "first_sample", F.size("left").alias("n"))
    assert one.exceptAll(two).count() == 0 and one.count() == rows.count()


def test_samples_are_shuffled_once(spark):
    made = {"a": (44100, "F32", np.zeros(5000), None)}
    FI.filter_window_sums(packets(spark, made))  # the small block table is computed here
    plan = FI.filter_window_sums(packets(spark, made))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(album" in line]
    assert sum("__chunk" in line for line in moved) <= 2 and "packet_no" not in "".join(moved)


def test_sample_formats_agree(spark):
    x = np.round(np.random.default_rng(2).normal(size=4410) * 3000)
    made = {"S16": (44100, "S16", x, None), "F32": (44100, "F32", x / 32768, None), "S32": (44100, "S32", x * 65536, None)}
    got = tracks_of(spark, made)
    assert len({(r.loudness_db, r.peak) for r in got.values()}) == 1
    peaks = {r.track: r.peak for r in W.packet_peak(packets(spark, made)).collect()}
    assert peaks == pytest.approx({k: np.abs(x).max() / 32768 for k in made})


def test_worker_code_needs_no_installed_package(tmp_path):
    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(lambda: FI.run_filter(8000).apply(np.ones(300))[0].sum()))
    code = "import pickle; print(pickle.load(open('f.pkl', 'rb'))())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True)
    assert float(done.stdout) == pytest.approx(FI.run_filter(8000).apply(np.ones(300))[0].sum()), done.stderr


def test_packets_without_a_right_channel_inside_a_stereo_track(spark):
    left, right = np.random.default_rng(5).normal(size=(2, 6000)) * 0.1
    whole = packets(spark, {"t": (44100, "F32", left, right)}, size=1000)
    mixed = whole.withColumn("right", F.when(F.col("packet_no") != 2, F.col("right")))
    filled = right.copy()
    filled[2000:3000] = left[2000:3000]
    want = packets(spark, {"t": (44100, "F32", left, filled)}, size=1000)
    sums = lambda p: sorted((r.window_no, r.sum_squares) for r in FI.filter_window_sums(O.packet_offsets(p)).collect())
    assert sums(mixed) == sums(want)


def test_unsupported_rates_become_error_rows(spark):
    made = {"ok": (8000, "F32", [0.1] * 10, None), "bad": (88200, "F32", [0.1] * 10, None), "odd": (99999, "F32", [0.1], None)}
    rows = packets(spark, made)
    errors = rows.select("track", FI.rate_error(F.col("sample_rate")).alias("e")).distinct().collect()
    assert {r.track: r.e for r in errors} == {"ok": None, "bad": "Unsupported sample rate: 88200 Hz", "odd": "Unsupported sample rate: 99999 Hz"}
    joined = {r.track: r.error for r in FI.join_coefficients(rows).collect()}
    assert joined["ok"] is None and joined["bad"] == "Unsupported sample rate: 88200 Hz"
    assert set(tracks_of(spark, made)) == {"ok"}
    assert FI.coefficients(spark).count() == 11


def test_missing_packets_close_up_and_are_reported(spark):
    made = {"t": (44100, "F32", np.arange(5000) / 5000, None)}
    rows = packets(spark, made, size=1000).where("packet_no <> 2")
    placed = {r.packet_no: r.first_sample for r in O.packet_offsets(rows, block_size=2).collect()}
    assert placed == {0: 0, 1: 1000, 3: 2000, 4: 3000}
    gaps = O.packet_gaps(rows).first()
    assert (gaps.packets, gaps.missing) == (4, 1)


def test_shipped_function_does_not_grow_with_the_kernels_made_here():
    from pyspark import cloudpickle

    FI.run_filter(44100)
    few = len(cloudpickle.dumps(FI.run_filter))
    for rate in FI.supported_rates():
        FI.run_filter(rate)
    assert len(cloudpickle.dumps(FI.run_filter)) == few


def test_peak_belongs_to_its_window_and_null_album_is_a_key(spark):
    signal = np.full(44100, 0.01)
    signal[10] = 0.9
    rows = packets(spark, {"a": (44100, "F32", signal, None)}, size=441).withColumn("album", F.lit(None).cast("string"))
    got = {r.window_no: r.peak for r in FI.filter_window_sums(rows, chunk=8000).collect()}
    assert len(got) == 20 and got.pop(0) == pytest.approx(0.9, rel=1e-6)
    assert all(p == pytest.approx(0.01, rel=1e-6) for p in got.values())
