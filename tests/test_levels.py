import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loudframe.contracts import ORACLES, QUERIES
from loudframe.functions import gains as G
from loudframe.functions import levels as L


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize("db,steps", [(0.0, 0), (1.5, 1), (3.0, 2), (-1.5, -1), (2.25, 2), (0.75, 1), (-0.75, -1)])
def test_db_to_steps(spark, db, steps):
    assert one(spark, L.db_to_steps(F.lit(db))) == (steps,)


def test_steps_to_db_and_saturation(spark):
    assert one(spark, L.steps_to_db(F.lit(-2)), L.steps_to_db(F.lit(1))) == (-3.0, 1.5)
    big = [L.saturating_int(F.lit(v)) for v in (1e12, -1e12, float("nan"), -1.9, 1.9)]
    assert one(spark, *big) == (2147483647, -2147483648, 0, -1, 1)


def test_level_bins_truncate_toward_zero(spark):
    # 0 dB is bin 2000 and so is everything within 0.01 dB on both sides.
    for db, bin_ in ((0.0, 2000), (0.009, 2000), (-0.009, 2000), (0.0101, 2001), (-0.0101, 1999), (-20.02, None),
                     (-19.995, 1), (100.01, None), (99.991, 11999)):
        assert one(spark, L.level_bin(F.lit(10 ** (db / 10)))) == (bin_,), db
    assert one(spark, L.level_bin(F.lit(0.0)), L.level_bin(F.lit(float("nan")))) == (None, 2000)


def test_window_samples_are_floored(spark):
    assert one(spark, *[L.window_samples(F.lit(r)) for r in (44100, 11025, 22050)]) == (2205, 551, 1102)


def test_peak_headroom_and_clipping(spark):
    assert one(spark, L.peak_headroom_db(F.lit(0.0))) == (math.inf,)
    assert one(spark, L.would_clip(F.lit(0.5), F.lit(6.0)), L.would_clip(F.lit(0.5), F.lit(6.1))) == (False, True)
    assert one(spark, L.field_headroom_steps(F.lit(200)), L.field_headroom_db(F.lit(200))) == (55, 82.5)


def test_fixed_text_rounds_like_exact_decimals(spark):
    random.seed(5)
    values = [random.gauss(0, 40) for _ in range(3000)] + [i / 8 for i in range(-60, 60)]
    values += [i + 0.005 for i in range(-60, 60)] + [-0.001, 1.005, 2.675, 6.625, 1e15 + 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", L.fixed_text(F.col("v"), 2).alias("two"), L.fixed_text(F.col("v"), 6, sign=True).alias("six")
    )
    for row in rows.collect():
        assert (row.two, row.six) == (f"{row.v:.2f}", f"{row.v:+.6f}")


def test_adjustment_modes(spark):
    cases = [(250, 10, 255, 4), (5, -10, 0, 251), (100, 20, 120, 120), (0, -300, 0, 212)]
    for gain, steps, saturated, wrapped in cases:
        got = one(spark, G.adjust_saturating(F.lit(gain), F.lit(steps)), G.adjust_wrapping(F.lit(gain), F.lit(steps)))
        assert got == (saturated, wrapped)


def test_limit_by_headroom(spark):
    kept = one(spark, G.limit_by_headroom(F.lit(10), F.lit(4), prevent=True))[0]
    assert (kept.steps, kept.warning) == (4, "gain reduced from 10 to 4 steps to prevent clipping")
    warned = one(spark, G.limit_by_headroom(F.lit(10), F.lit(4)))[0]
    assert (warned.steps, warned.warning) == (10, "clipping warning: requested 10 steps but only 4 headroom")
    for options in ({"ignore": True}, {"wrap": True}):
        assert tuple(one(spark, G.limit_by_headroom(F.lit(10), F.lit(4), **options))[0]) == (10, None)
    assert tuple(one(spark, G.limit_by_headroom(F.lit(-10), F.lit(4), prevent=True))[0]) == (-10, None)


def test_limit_by_peak_never_exceeds_the_request_and_never_clips(spark):
    rows = spark.range(1, 2000).select(
        (F.col("id") % 40 - 5).cast("int").alias("steps"), (F.col("id") / 1000).alias("peak")
    )
    out = rows.withColumn("l", G.limit_by_peak(F.col("steps"), F.lit(0.0), F.col("peak"), prevent=True))
    bad = out.where(
        (F.col("l.steps") > F.col("steps"))
        | ((F.col("steps") > 0) & (F.col("l.steps") > 0) & (F.col("peak") * F.pow(10.0, F.col("l.steps") * 1.5 / 20) > 1.0000001))
    )
    assert bad.count() == 0


def test_limit_by_peak_compat_checks_the_own_gain(spark):
    # 3 dB on a peak of 0.9 clips; the nearest safe step count is round(0.915 / 1.5) = 1.
    limited = one(spark, G.limit_by_peak(F.lit(2), F.lit(3.0), F.lit(0.9), prevent=True, compat=True))[0]
    assert (limited.steps, limited.warning) == (1, "gain reduced from 2 to 1 steps to prevent clipping (peak: 0.9000)")
    unlimited = one(spark, G.limit_by_peak(F.lit(2), F.lit(0.5), F.lit(0.9), prevent=True, compat=True))[0]
    assert (unlimited.steps, unlimited.warning) == (2, None)


def test_logarithm_of_zero_and_below(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (100.0,), (-1.0,), (float("nan"),), (None,)], "v double")
    got = [r[0] for r in rows.select(F.round(L.log10(F.col("v")), 9)).collect()]
    assert got[:3] == [float("-inf"), float("-inf"), 2.0] and math.isnan(got[3]) and math.isnan(got[4]) and got[5] is None


def test_saturation_leaves_null(spark):
    nothing = F.lit(None).cast("double")
    assert one(spark, L.saturating_int(nothing), L.db_to_steps(nothing), L.level_bin(nothing)) == (None, None, None)


def test_level_math_on_odd_values(spark, tmp_path):
    # Nothing, less than nothing, factors of ten digits and more, values beyond 32 bits.
    values = [None, 0.0, -0.0, -1.5, 0.5, 1e-300, 1013.28, 2457.86, 4457.94, 2.0**31 + 250.5, -3e9, 4e15, 6.1e9 + 0.3] + [1000 + i * 1.37 for i in range(3000)]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(ORACLES["level_math"]).to_arrow_table().to_pylist()
    got = QUERIES["level_math"](spark, str(tmp_path)).toArrow().to_pylist()
    by_id = lambda rows: [repr(r) for r in sorted(rows, key=lambda r: r["event_id"])]
    assert by_id(got) == by_id([{k: r[k] for k in got[0]} for r in want])
