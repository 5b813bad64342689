import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loudframe.operators import histogram as H
from loudframe.operators import loudness as LO
from loudframe.operators import ordered as O
from loudframe.operators import windows as W


def brute_percentile(counts):
    total = sum(counts.values())
    if total == 0:
        return -20.0
    need, seen = math.ceil(total * (1.0 - 0.95)), 0
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if seen >= need:
            return (b - 2000) / 100


@pytest.mark.parametrize("total,rank", [(1, 1), (19, 1), (20, 2), (21, 2), (40, 3), (100, 6), (1000, 51)])
def test_percentile_rank(spark, total, rank):
    """One window per bin: the rank picks the bin."""
    rows = spark.range(total).select(F.lit("t").alias("track"), (F.col("id") + 5000).cast("int").alias("bin"), F.lit(1).cast("bigint").alias("cnt"))
    got = H.percentile_loudness(rows, ["track"]).first()
    assert got.loudness_db == (5000 + total - rank - 2000) / 100 and got.windows == total


def test_random_histograms(spark):
    rng = random.Random(6)
    made = {t: {rng.randrange(12000): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))} for t in range(40)}
    rows = [(t, b, c) for t, counts in made.items() for b, c in counts.items()] + [(99, None, 7)]
    hist = spark.createDataFrame(rows, "track int, bin int, cnt bigint")
    got = {r.track: r.loudness_db for r in H.percentile_loudness(hist, ["track"]).collect()}
    assert got == {**{t: brute_percentile(c) for t, c in made.items()}, 99: -20.0}


def test_merge_equals_histogram_of_the_union(spark):
    rows = spark.range(4000).select((F.col("id") % 7).alias("track"), F.floor(F.col("id") / 13).alias("window_no"),
                                    (F.hash("id") % 3000).cast("double").alias("v"))
    sums = W.window_sums(rows, ["track"], F.col("window_no"), 1, F.col("v"))
    parts = H.loudness_bins(sums, ["track"])
    merged = H.merge_histograms(parts, []).select("bin", "cnt")
    whole = H.loudness_bins(sums, []).select("bin", "cnt")
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def hot_samples(spark, hot=30000, tracks=40):
    """One track holds a third of all rows."""
    cold = spark.range(hot * 2).select((F.col("id") % tracks + 1).alias("track"), F.col("id"))
    rows = spark.range(hot).select(F.lit(0).cast("bigint").alias("track"), (F.col("id") + 10**6).alias("id"))
    all_rows = rows.unionByName(cold)
    return all_rows.select("track", F.timestamp_seconds(1700000000 + F.col("id") % 9973 * 60).alias("ts"), "id",
                           (F.hash("id") % 1000).cast("bigint").alias("v"))


@pytest.mark.parametrize("kind", ["time", "range"])
def test_sample_index_with_a_hot_track(spark, kind):
    rows = hot_samples(spark)
    block = O.time_blocks("ts", 86400) if kind == "time" else None
    got = O.sample_index(rows, ["track"], ["ts", "id"], block)
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("ts", "id")).cast("bigint") - 1)
    assert got.count() == want.count() and want.exceptAll(got.select(want.columns)).count() == 0


def test_hot_track_is_cut_into_bounded_parts(spark):
    """No window over rows spans a whole key: blocks are part of its partition."""
    plan = O.sample_index(hot_samples(spark), ["track"], ["ts", "id"], O.time_blocks("ts", 86400))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("__block" in line.rsplit("], [", 2)[1] for line in windows) == 1


def test_running_values(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), i, rng.randrange(-5, 6), rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, s int, x int")
    got = O.running_totals(df, ["k"], ["i"], {"total": F.col("s")}, O.number_blocks("i", 16),
                           firsts={"first": F.col("x")}, lasts={"last": F.col("x")})
    by = {r.i: r for r in got.collect()}
    assert len(by) == 400
    state = {}
    for k, i, s, x in rows:
        total, first, last = state.get(k, (0, None, None))
        state[k] = (total + s, x if first is None else first, last if x is None else x)
        assert (by[i].total, by[i]["first"], by[i]["last"]) == state[k]


def test_fir_across_blocks(spark):
    rng = random.Random(9)
    x = [rng.random() for _ in range(500)]
    rows = spark.createDataFrame([("t", n, v) for n, v in enumerate(x)], "track string, n bigint, v double")
    weights = [0.5, -1.0, 0.25, 0.125]
    got = {r.n: r.y for r in O.fir(rows, ["track"], "n", "v", weights, block_size=32).collect()}
    assert len(got) == 500
    for n in range(500):
        assert got[n] == pytest.approx(sum(w * x[n - k] for k, w in enumerate(weights) if n >= k))


def test_partial_last_window_and_mono(spark):
    rows = spark.createDataFrame([("t", i, 2.0) for i in range(7)], "track string, n bigint, v double")
    got = W.window_mean_square(rows, ["track"], F.col("n"), 5, F.col("v")).orderBy("window_no").collect()
    assert [(r.samples, r.mean_square) for r in got] == [(5, 4.0), (2, 4.0)]


def test_levels_of_tracks_albums_and_library(spark):
    rows = [("a", "x", 0, 2e6, 1, 5), ("a", "x", 1, 2e4, 1, 9), ("a", "y", 0, 2e8, 1, 3), ("b", "z", 0, 1e-9, 1, 1)]
    sums = spark.createDataFrame(rows, "album string, track string, window_no bigint, sum_squares double, samples bigint, peak int")
    tracks, albums = LO.level_tables(sums, ["album", "track"], ["album"])
    assert {r.track: r.loudness_db for r in tracks.collect()} == {"x": 60.0, "y": 80.0, "z": -20.0}
    assert {r.album: (r.album_loudness_db, r.album_peak) for r in albums.collect()} == {"a": (80.0, 9), "b": (-20.0, 1)}
    roll = LO.loudness_rollup(H.loudness_bins(sums, ["album", "track"], keep_outside=True)).collect()
    assert {(r.level, r.album, r.track): r.loudness_db for r in roll} == {
        ("track", "a", "x"): 60.0, ("track", "a", "y"): 80.0, ("track", "b", "z"): -20.0, ("album", "a", None): 80.0,
        ("album", "b", None): -20.0, ("library", None, None): 80.0,
    }


def test_album_modes(spark):
    tracks = spark.createDataFrame([("a", 1, None), ("a", 2, "bad"), ("b", 3, None)], "album string, track int, error string")
    albums = spark.createDataFrame([("a", 70.0), ("b", 60.0)], "album string, album_loudness_db double")
    strict = {r.album: (r.tracks, r.failed, r.error, r.album_loudness_db) for r in LO.fail_fast_albums(tracks, albums, ["album"]).collect()}
    assert strict == {"a": (2, 1, "bad", None), "b": (1, 0, None, 60.0)}
    loose = {r.album: r.album_loudness_db for r in LO.fail_fast_albums(tracks, albums, ["album"], "permissive").collect()}
    assert loose == {"a": 70.0, "b": 60.0}


def test_null_keys_are_keys_of_their_own(spark):
    rows = spark.range(9000).select(F.lit(None).cast("string").alias("album"), F.lit("t").alias("track"),
                                    F.col("id").alias("packet_no"), F.array(F.lit(0.0)).alias("left"))
    got = O.packet_offsets(rows)
    assert got.count() == 9000 and got.where("first_sample <> packet_no").count() == 0
