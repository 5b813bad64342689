"""Stored levels that follow their tracks: a changed track updates its album without the others' histograms.

A histogram is packed into one map per row, bin to count, and maps are added and subtracted with map
functions. The album's map takes the difference between a track's new and old map; only the peak, which
can't be subtracted, is taken anew from the peak column of the album's tracks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.functions import levels as L
from loudframe.operators.loudness import join_null_safe
from loudframe.session import durable
from loudframe.streaming.store import MergedTable

BINS = "map<int,bigint>"


def packed(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: ``bins`` (bin to count, at most 12,000 entries) and ``peak``. Windows outside the histogram only count for the peak."""
    entry = F.when(F.col("bin").isNotNull(), F.struct(F.col("bin").cast("int").alias("bin"), F.col("cnt").cast("bigint").alias("cnt")))
    found = hist.groupBy(*keys).agg(F.collect_list(entry).alias("e"), F.max("peak").cast("double").alias("peak"))
    return found.select(*keys, F.map_from_entries("e").cast(BINS).alias("bins"), "peak")


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The sum of two packed histograms, or ``a`` without ``b``; bins that come to zero go. NULL has no windows."""
    none = F.create_map().cast(BINS)
    zero = F.lit(0).cast("bigint")
    both = F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(x, zero) + sign * F.coalesce(y, zero))
    return F.map_filter(both, lambda _, n: n != 0)


def packed_windows(bins: Column) -> Column:
    return F.aggregate(F.map_values(bins), F.lit(0).cast("bigint"), lambda a, n: a + n)


def packed_loudness(bins: Column, percentile: float = C.PERCENTILE) -> Column:
    """Percentile loudness inside the row: bins from the loudest down until the share is reached; -20.0 without windows."""
    need = F.ceil(packed_windows(bins).cast("double") * (F.lit(1.0) - F.lit(float(percentile))))
    down = F.reverse(F.array_sort(F.map_entries(bins)))
    start = F.struct(F.lit(0).cast("bigint").alias("cum"), F.lit(None).cast("int").alias("bin"))
    found = F.aggregate(down, start, lambda a, e: F.struct(
        (a["cum"] + e["value"]).alias("cum"),
        F.coalesce(a["bin"], F.when(a["cum"] + e["value"] >= need, e["key"])).alias("bin")))
    return F.coalesce(L.bin_db(found["bin"]), F.lit(C.EMPTY_LOUDNESS_DB))


def levels(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows, loudness, gain and peak from packed rows; no shuffle and no window function."""
    gain = L.suggest_gain(F.col("loudness_db"))
    return rows.select(*keys, packed_windows(F.col("bins")).alias("windows"), packed_loudness(F.col("bins")).alias("loudness_db"), "peak").withColumns(
        {"gain_db": gain, "gain_steps": L.db_to_steps(gain)})


class LevelStore:
    """Packed histograms of tracks and albums below ``root``, kept up to date by batches of changed tracks.

    ``keys`` name a track, ``album`` (some of them) its album; a track does not move to another album under the
    same keys. Batches of a writer are numbered upwards, and one that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("album", "track"), album: Sequence[str] = ("album",), every: int = 8):
        self._spark, self._keys, self._album = spark, list(keys), list(album)
        self._tracks = MergedTable(spark, f"{root}/tracks", self._latest(self._keys), every)
        self._albums = MergedTable(spark, f"{root}/albums", self._latest(self._album), every)

    @staticmethod
    def _latest(keys: list[str]):
        """The row of the latest batch for each key; a row whose bins are NULL is a track that has gone."""
        def merge(rows: DataFrame) -> DataFrame:
            newest = rows.groupBy(*keys).agg(F.max_by(F.struct("bins", "peak"), "version").alias("v"), F.max("version").alias("version"))
            return newest.select(*keys, "v.bins", "v.peak", "version")
        return merge

    def tracks(self) -> DataFrame:
        return self._tracks.read().where("bins IS NOT NULL").drop("version")

    def albums(self) -> DataFrame:
        return self._albums.read().where("bins IS NOT NULL").drop("version")

    def put(self, hist: DataFrame, batch_id: int, writer: str = "", gone: DataFrame | None = None) -> None:
        """Replace or add the tracks of ``hist`` (keys, bin, cnt, peak), and take out those of ``gone`` (keys).

        Of the tracks that stay only keys and peaks are read, of the albums the changed ones. Albums are
        written before tracks: an attempt that is repeated after the first of them finds the old tracks still there.
        """
        new = packed(hist, self._keys)
        if gone is not None:
            left = join_null_safe(gone.select(*self._keys).distinct(), new, self._keys, "left_anti")
            new = new.unionByName(left.select(*self._keys, F.lit(None).cast(BINS).alias("bins"), F.lit(None).cast("double").alias("peak")))
        version = max([*self._tracks.manifest().last.values(), *self._albums.manifest().last.values(), -1])
        new = durable(new.withColumn("version", F.lit(max(version + 1, batch_id)).cast("bigint")))
        if batch_id > self._albums.manifest().last.get(writer, -1):
            self._albums.add(self._changed_albums(new), batch_id, writer)
        self._tracks.add(new, batch_id, writer)

    def _changed_albums(self, new: DataFrame) -> DataFrame:
        bins = [F.col("bins").alias("new_bins"), F.lit(None).cast(BINS).alias("old_bins"), F.col("peak").alias("new_peak")]
        changed = new.select(*self._keys, *bins)
        albums = new.select(*self._album, "version").distinct()
        if not self._tracks.manifest().folders:
            others = changed.select(*self._album, "new_peak")
            before = albums.select(*self._album, F.lit(None).cast(BINS).alias("bins"))
        else:
            stored = self._tracks.read().where("bins IS NOT NULL")
            old = join_null_safe(stored.select(*self._keys, "bins"), new.select(*self._keys), self._keys, "left_semi")
            changed = join_null_safe(new.select(*self._keys, F.col("bins").alias("new_bins")), old.withColumnRenamed("bins", "old_bins"), self._keys)
            stay = join_null_safe(stored.select(*self._keys, F.col("peak").alias("new_peak")), new.select(*self._keys), self._keys, "left_anti")
            near = join_null_safe(stay.select(*self._album, "new_peak"), albums.select(*self._album), self._album, "left_semi")
            others = near.union(new.where("bins IS NOT NULL").select(*self._album, F.col("peak").alias("new_peak")))
            before = join_null_safe(self._albums.read().where("bins IS NOT NULL").select(*self._album, "bins"), albums.select(*self._album), self._album, "left_semi")
        moved = changed.select(*self._album, F.explode(added(F.col("new_bins"), F.col("old_bins"), -1)).alias("bin", "n"))
        moved = moved.groupBy(*self._album, "bin").agg(F.sum("n").alias("n")).groupBy(*self._album).agg(
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).cast(BINS).alias("moved"))
        peaks = others.groupBy(*self._album).agg(F.max("new_peak").alias("peak"))
        rows = join_null_safe(join_null_safe(join_null_safe(albums, before, self._album), moved, self._album), peaks, self._album)
        # An album without tracks has no peak any more, and goes.
        total = F.when(F.col("peak").isNotNull(), added(F.col("bins"), F.col("moved")))
        return rows.select(*self._album, total.alias("bins"), "peak", "version")
