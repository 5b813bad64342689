"""Stored levels against full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from loudframe.operators import histogram as H
from loudframe.operators import level_store as LS
from loudframe.operators import loudness as LO

KEYS = ["album", "track"]


def hist(spark, rows):
    return spark.createDataFrame(rows, "album string, track string, bin int, cnt long, peak double")


def draw(rng, album, track):
    bins = rng.sample(range(3000, 3040), rng.randrange(1, 12))
    return [(album, track, b, rng.randrange(1, 30), rng.random()) for b in bins] + [(album, track, None, 2, rng.random())]


def compared(spark, store, rows):
    full = hist(spark, rows)
    for got, want, keys in ((store.tracks(), LO.track_levels(full, KEYS), KEYS), (store.albums(), LO.track_levels(H.merge_histograms(full, ["album"]), ["album"]), ["album"])):
        columns = [*keys, "windows", "loudness_db", "gain_steps", "peak"]
        assert sorted(LS.levels(got, keys).select(columns).collect(), key=str) == sorted(want.select(columns).collect(), key=str)


def test_changed_new_and_gone_tracks(spark, tmp_path):
    rng = random.Random(1)
    now = {(a, t): draw(rng, a, t) for a in ("x", "y", None) for t in "abcd"} | {("quiet", "q"): [("quiet", "q", None, 3, 0.5)]}
    flat = lambda tracks: [r for rows in tracks for r in rows]
    store = LS.LevelStore(spark, str(tmp_path / "s"), every=2)
    store.put(hist(spark, flat(now.values())), 0)
    compared(spark, store, flat(now.values()))
    for batch in range(1, 5):
        changed = {k: draw(rng, *k) for k in [*rng.sample(sorted(now, key=str), 2), ("x", f"new{batch}"), ("fresh", f"{batch}")]}
        gone = [k for k in (("x", "a"), ("y", "b"), ("quiet", "q")) if batch == 2 and k not in changed]
        rows = hist(spark, flat(changed.values()))
        out = spark.createDataFrame(gone, "album string, track string") if gone else None
        for _ in range(2):  # each batch comes twice
            store.put(rows, batch, gone=out)
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        compared(spark, store, flat(now.values()))


def test_a_repeated_batch_after_half_of_it(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    first, second = [draw(rng, "x", t) for t in "ab"], draw(rng, "x", "a")
    store = LS.LevelStore(spark, str(tmp_path / "s"))
    store.put(hist(spark, [r for t in first for r in t]), 0)
    whole = store._tracks.add
    monkeypatch.setattr(store._tracks, "add", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.put(hist(spark, second), 1)
    monkeypatch.setattr(store._tracks, "add", whole)
    store.put(hist(spark, second), 1)
    compared(spark, store, second + first[1])


def test_histograms_of_other_tracks_are_not_read(spark, tmp_path):
    rng = random.Random(3)
    store = LS.LevelStore(spark, str(tmp_path / "s"))
    store.put(hist(spark, [r for t in "abc" for r in draw(rng, "x", t)]), 0)
    new = LS.packed(hist(spark, draw(rng, "x", "a")), KEYS).withColumn("version", F.lit(1).cast("bigint"))
    plan = store._changed_albums(new)._jdf.queryExecution().optimizedPlan().toString()
    assert "map_zip_with" in plan and "Window" not in plan


def test_packed_arithmetic(spark):
    row = spark.range(1).select(F.create_map(F.lit(1), F.lit(2).cast("bigint"), F.lit(3), F.lit(4).cast("bigint")).alias("a"),
                                F.create_map(F.lit(3), F.lit(4).cast("bigint"), F.lit(5), F.lit(6).cast("bigint")).alias("b"))
    got = row.select(LS.added(F.col("a"), F.col("b")).alias("s"), LS.added(F.col("a"), F.col("b"), -1).alias("d"), LS.added(F.col("a"), F.lit(None).cast(LS.BINS)).alias("n")).first()
    assert (got.s, got.d, got.n) == ({1: 2, 3: 8, 5: 6}, {1: 2, 5: -6}, {1: 2, 3: 4})
