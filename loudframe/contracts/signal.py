"""Levels, histograms, loudness, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.contracts.roles import (
    ALBUMS, HISTOGRAM, KEYS, PER_WINDOW, SAMPLES, STEPS, TRACKS, WINDOWS, contract, indexed_samples, level_sql, packets,
    samples, table, windows,
)
from loudframe.functions import levels as L
from loudframe.operators import affine as AF
from loudframe.operators import filtering as FI
from loudframe.operators import histogram as H
from loudframe.operators import loudness as LO
from loudframe.operators import ordered as O
from loudframe.operators import windows as W
from loudframe.operators.level_store import LevelStore, levels
from loudframe.session import fresh_path
from loudframe.sources import packets as PK

# --- scalar level functions on events ------------------------------------------------------


def _level_input(spark, sf_dir):
    """A gain in dB around zero and a peak around full scale per event."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        ((F.col("value") - 250) / 20).alias("gain_db"),
        (F.col("value") / 333).alias("peak"),
        (F.col("event_id") % 256).cast("int").alias("max_gain"),
        (F.col("event_id") % 41 - 20).cast("int").alias("steps"),
    )


_LEVELS = """
i AS (SELECT event_id, (value - 250e0) / 20e0 AS gain_db, value / 333e0 AS peak,
             CAST(event_id % 256 AS INTEGER) AS max_gain, CAST(event_id % 41 - 20 AS INTEGER) AS steps
      FROM events)"""


@contract(f"WITH {_LEVELS} SELECT event_id, CAST(round(gain_db / 1.5e0) AS INTEGER) AS steps FROM i")
def db_to_steps(spark, sf_dir):
    return _level_input(spark, sf_dir).select("event_id", L.db_to_steps(F.col("gain_db")).alias("steps"))


@contract(f"WITH {_LEVELS} SELECT event_id, steps * 1.5e0 AS gain_db FROM i")
def steps_to_db(spark, sf_dir):
    return _level_input(spark, sf_dir).select("event_id", L.steps_to_db(F.col("steps")).alias("gain_db"))


@contract("SELECT event_id, round(64.82e0 - value, 6) AS gain_db FROM events")
def suggest_gain(spark, sf_dir):
    gain = L.suggest_gain(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.round(gain, 6).alias("gain_db"))


@contract(f"""
WITH {_LEVELS}
SELECT event_id, round(gain_db + 2.5e0, 6) AS by_db, CAST(round((gain_db + 2.5e0) / 1.5e0) AS INTEGER) AS steps_by_db,
       CAST(round(gain_db / 1.5e0) AS INTEGER) - 3 AS steps_by_steps, round(92e0 - 89e0 + gain_db, 6) AS by_target
FROM i""")
def retarget(spark, sf_dir):
    gain = F.col("gain_db")
    return _level_input(spark, sf_dir).select(
        "event_id",
        F.round(L.retarget_db(gain, 2.5), 6).alias("by_db"),
        L.db_to_steps(L.retarget_db(gain, 2.5)).alias("steps_by_db"),
        L.retarget_steps(gain, -3).alias("steps_by_steps"),
        F.round(L.target_gain(gain, 92.0), 6).alias("by_target"),
    )


@contract(f"WITH {_LEVELS} SELECT event_id, round(89e0 - gain_db, 6) AS volume FROM i")
def display_volume(spark, sf_dir):
    volume = L.display_volume(F.col("gain_db"))
    return _level_input(spark, sf_dir).select("event_id", F.round(volume, 6).alias("volume"))


@contract(f"""
WITH {_LEVELS}
SELECT event_id, peak * pow(10e0, gain_db / 20e0) > 1e0 AS would_clip, peak >= 1e0 AS clipping FROM i""")
def would_clip(spark, sf_dir):
    return _level_input(spark, sf_dir).select(
        "event_id",
        L.would_clip(F.col("peak"), F.col("gain_db")).alias("would_clip"),
        L.is_clipping(F.col("peak")).alias("clipping"),
    )


@contract(f"""
WITH {_LEVELS},
z AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0e0 ELSE peak END AS peak,
             CASE WHEN event_id % 2 = 0 THEN 'MP3' ELSE 'm4a' END AS kind FROM i)
SELECT event_id, CASE WHEN peak > 0 THEN round(-20e0 * log10(peak), 6) END AS headroom_db, peak = 0 AS silent,
       lower(kind) = 'mp3' AND peak >= 0.9999e0 AS may_be_clipped
FROM z""")
def peak_headroom(spark, sf_dir):
    peak = F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("peak"))
    kind = F.when(F.col("event_id") % 2 == 0, "MP3").otherwise("m4a")
    room = L.peak_headroom_db(peak)
    infinite = room == F.lit(float("inf"))
    return _level_input(spark, sf_dir).select(
        "event_id",
        F.when(~infinite, F.round(room, 6)).alias("headroom_db"),
        infinite.alias("silent"),
        L.may_be_clipped(kind, peak).alias("may_be_clipped"),
    )


@contract(f"""
WITH {_LEVELS}
SELECT event_id, 255 - max_gain AS headroom_steps, (255 - max_gain) * 1.5e0 AS headroom_db,
       round(pow(10e0, -((255 - max_gain) * 1.5e0) / 20e0), 9) AS estimated_peak
FROM i""")
def field_headroom(spark, sf_dir):
    gain = F.col("max_gain")
    return _level_input(spark, sf_dir).select(
        "event_id",
        L.field_headroom_steps(gain).alias("headroom_steps"),
        L.field_headroom_db(gain).alias("headroom_db"),
        F.round(L.estimated_peak(gain), 9).alias("estimated_peak"),
    )


@contract("""
SELECT event_id, round(log10(value), 9) AS lg, round(pow(10e0, value / 200e0), 6) AS factor,
       CAST(ceil(value) AS BIGINT) AS up, CAST(round(value) AS BIGINT) AS nearest,
       CAST(trunc(value - 250e0) AS BIGINT) AS toward_zero, round(abs(value - 250e0), 6) AS magnitude
FROM events""")
def level_math(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        L.to_places(L.log10(v), 9).alias("lg"),
        L.to_places(L.pow10(v / 200), 6).alias("factor"),
        F.ceil(v).alias("up"),
        F.round(v).cast("bigint").alias("nearest"),
        (v - 250).cast("bigint").alias("toward_zero"),
        L.to_places(F.abs(v - 250), 6).alias("magnitude"),
    )


# --- windows, histograms ------------------------------------------------------------------


@contract(f"WITH {SAMPLES} SELECT album, track, event_id, n FROM s")
def sample_position(spark, sf_dir):
    return indexed_samples(spark, sf_dir).select(*KEYS, "event_id", "n")


@contract(f"""
WITH {WINDOWS}
SELECT album, track, window_no, samples, round(sum_squares::DOUBLE / samples::DOUBLE * 0.5e0, 6) AS mean_square FROM w""")
def window_mean_square(spark, sf_dir):
    out = W.window_mean_square(indexed_samples(spark, sf_dir), KEYS, F.col("n"), PER_WINDOW, F.col("v"))
    return out.withColumn("mean_square", F.round("mean_square", 6))


@contract(f"WITH {HISTOGRAM} SELECT album, track, bin, cnt FROM h")
def loudness_bins(spark, sf_dir):
    return H.loudness_bins(windows(spark, sf_dir), KEYS).select(*KEYS, "bin", "cnt")


@contract("""
SELECT 0 AS album, label AS track, round(max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 9) AS peak
FROM embeddings GROUP BY ALL""")
def peak(spark, sf_dir):
    return W.packet_peak(packets(spark, sf_dir)).withColumn("peak", F.round("peak", 9))


@contract("""
SELECT label AS track, round(max(m), 9) AS peak, round(max(m) * 32768e0, 6) AS peak_pcm
FROM (SELECT label, greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))),
                             list_max(list_transform(embedding, lambda x: abs(x::DOUBLE) / 2e0)),
                             abs(embedding[1]::DOUBLE * 3e0)) AS m
      FROM embeddings)
GROUP BY ALL""")
def peak_all_channels(spark, sf_dir):
    """Three channels: the samples, the samples at half level and one loud sample."""
    first = packets(spark, sf_dir).select(
        "track",
        "format",
        F.array("left", F.transform("left", lambda x: x / 2), F.array(F.get("left", F.lit(0)) * 3)).alias("channels"),
    )
    out = W.peak_all_channels(first, ["track"])
    return out.withColumns({"peak": F.round("peak", 9), "peak_pcm": F.round("peak_pcm", 6)})


@contract("""
WITH f AS (SELECT vec_id, ['S16', 'S32', 'F32'][CAST(vec_id % 3 AS INTEGER) + 1] AS format, embedding FROM embeddings),
x AS (SELECT vec_id, format, list_transform(embedding, lambda e: e::DOUBLE * (CASE format WHEN 'S16' THEN 1e0
        WHEN 'S32' THEN 32768e0 / 2147483648e0 ELSE 32768e0 END)) AS a FROM f)
SELECT vec_id, format, round(a[1], 9) AS first, round(a[33], 9) AS middle, round(a[64], 9) AS last,
       round(list_max(list_transform(a, lambda e: abs(e))), 9) AS top
FROM x""")
def normalize_samples(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("S16"), F.lit("S32"), F.lit("F32")), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("format"), "embedding")
    a = L.scale_samples(F.col("embedding"), F.col("format"))
    return rows.select("vec_id", "format", a.alias("a")).select(
        "vec_id",
        "format",
        F.round(F.get("a", F.lit(0)), 9).alias("first"),
        F.round(F.get("a", F.lit(32)), 9).alias("middle"),
        F.round(F.get("a", F.lit(63)), 9).alias("last"),
        F.round(L.array_peak(F.col("a")), 9).alias("top"),
    )


@contract("""
SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS peak FROM embeddings""")
def array_peak(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", L.array_peak(F.col("embedding")).cast("double").alias("peak"))


@contract(f"""
WITH {HISTOGRAM}
SELECT album, track, bin, cnt, CAST(sum(cnt) OVER (PARTITION BY album, track ORDER BY bin DESC) AS BIGINT) AS cum,
       CAST(sum(cnt) OVER (PARTITION BY album, track) AS BIGINT) AS total
FROM h""")
def reverse_cumulative(spark, sf_dir):
    hist = H.loudness_bins(windows(spark, sf_dir), KEYS)
    return H.reverse_cumulative(hist, KEYS).select(*KEYS, "bin", "cnt", "cum", "total")


@contract(f"WITH {TRACKS} SELECT album, track, loudness_db, windows FROM t")
def percentile_loudness(spark, sf_dir):
    hist = H.loudness_bins(windows(spark, sf_dir), KEYS)
    return H.percentile_loudness(hist, KEYS).select(*KEYS, "loudness_db", "windows")


@contract(f"WITH {HISTOGRAM} SELECT album, bin, CAST(sum(cnt) AS BIGINT) AS cnt FROM h GROUP BY ALL")
def merge_histograms(spark, sf_dir):
    hist = H.loudness_bins(windows(spark, sf_dir), KEYS)
    return H.merge_histograms(hist, ["album"]).select("album", "bin", "cnt")


@contract(f"""
WITH {TRACKS}
SELECT album, track, windows, loudness_db, round(64.82e0 - loudness_db, 4) AS gain_db,
       {STEPS.format('loudness_db')} AS gain_steps, peak
FROM t""")
def track_loudness(spark, sf_dir):
    out = LO.track_loudness(windows(spark, sf_dir), KEYS)
    return out.select(*KEYS, "windows", "loudness_db", F.round("gain_db", 4).alias("gain_db"), "gain_steps", "peak")


@contract(f"""
WITH {ALBUMS}
SELECT album, windows, loudness_db AS album_loudness_db, round(64.82e0 - loudness_db, 4) AS album_gain_db,
       {STEPS.format('loudness_db')} AS album_gain_steps, peak AS album_peak
FROM a""")
def album_loudness(spark, sf_dir):
    hist = H.loudness_bins(windows(spark, sf_dir), KEYS)
    return LO.album_loudness(hist, ["album"]).withColumn("album_gain_db", F.round("album_gain_db", 4))


@contract(f"""
WITH {ALBUMS},
lh AS (SELECT bin, CAST(sum(cnt) AS BIGINT) AS cnt, max(peak) AS peak FROM h GROUP BY ALL),
{level_sql('lh', '', 'lib')}
SELECT 'track' AS level, album, track, windows, loudness_db, peak FROM t
UNION ALL SELECT 'album', album, NULL, windows, loudness_db, peak FROM a
UNION ALL SELECT 'library', NULL, NULL, windows, loudness_db, peak FROM lib""")
def loudness_rollup(spark, sf_dir):
    hist = H.loudness_bins(windows(spark, sf_dir), KEYS)
    return LO.loudness_rollup(hist).select("level", *KEYS, "windows", "loudness_db", "peak")


@contract(f"""
WITH {ALBUMS}
SELECT t.album, t.track, t.loudness_db, a.loudness_db AS album_loudness_db, a.peak AS album_peak
FROM t LEFT JOIN a USING (album)""")
def join_album(spark, sf_dir):
    joined = LO.join_album(*LO.level_tables(windows(spark, sf_dir), KEYS, ["album"]), ["album"])
    return joined.select(*KEYS, "loudness_db", "album_loudness_db", "album_peak")


# --- levels that follow their tracks: three users' values are raised ------------------------------

_RAISED = "CASE WHEN user_id IN (1, 2, 3) THEN 777 ELSE 0 END"
_CHANGED = ALBUMS.replace("CAST(round(value * 100) AS BIGINT) AS v", f"CAST(round(value * 100) AS BIGINT) + {_RAISED} AS v")


@contract(f"""
WITH {_CHANGED}
SELECT 'track' AS level, album, track, windows, loudness_db, {STEPS.format('loudness_db')} AS gain_steps, CAST(peak AS DOUBLE) AS peak FROM t
UNION ALL SELECT 'album', album, NULL, windows, loudness_db, {STEPS.format('loudness_db')}, CAST(peak AS DOUBLE) FROM a""")
def replace_tracks(spark, sf_dir):
    """Three tracks of a stored level table are measured anew; their albums follow, and the batch comes twice."""
    whole = H.loudness_bins(windows(spark, sf_dir), KEYS)
    store = LevelStore(spark, fresh_path(spark, "levels"))
    store.put(whole, 0)
    three = samples(spark, sf_dir).where("track IN (1, 2, 3)").withColumn("v", F.col("v") + 777)
    placed = O.sample_index(three, KEYS, ["ts", "event_id"], O.time_blocks("ts", 6 * 3600))
    again = H.loudness_bins(W.window_sums(placed, KEYS, F.col("n"), PER_WINDOW, F.col("v")), KEYS)
    for _ in range(2):
        store.put(again, 1)
    tracks = levels(store.tracks(), KEYS).withColumn("level", F.lit("track"))
    albums = levels(store.albums(), ["album"]).withColumns({"level": F.lit("album"), "track": F.lit(None).cast("bigint")})
    return tracks.unionByName(albums).select("level", *KEYS, "windows", "loudness_db", "gain_steps", "peak")


_FAILED = "track % 50 = 7"


@contract(f"""
WITH {ALBUMS},
x AS (SELECT album, count(*) AS tracks, count(*) FILTER (WHERE {_FAILED}) AS failed FROM t GROUP BY ALL)
SELECT x.album, tracks, failed, CASE WHEN failed > 0 THEN 'broken' END AS error,
       CASE WHEN failed = 0 THEN a.loudness_db END AS album_loudness_db
FROM x LEFT JOIN a USING (album)""")
def album_fail_fast(spark, sf_dir):
    tracks, albums = LO.level_tables(windows(spark, sf_dir), KEYS, ["album"])
    tracks = tracks.withColumn("error", F.expr(f"CASE WHEN {_FAILED} THEN 'broken' END"))
    out = LO.fail_fast_albums(tracks, albums, ["album"])
    return out.select("album", "tracks", "failed", "error", "album_loudness_db")


@contract(f"""
WITH {TRACKS},
x AS (SELECT album, track, max(CASE WHEN cum >= ceil(total::DOUBLE * (1e0 - 0.95e0)) THEN bin END) AS limit_bin
      FROM t_c GROUP BY ALL)
SELECT b.album, b.track, b.window_no, b.raw AS bin FROM b JOIN x USING (album, track)
WHERE b.raw BETWEEN 0 AND 11999 AND b.raw >= x.limit_bin""")
def loudest_windows(spark, sf_dir):
    return H.loudest_windows(windows(spark, sf_dir), KEYS).select(*KEYS, "window_no", "bin")


@contract(f"""
WITH {TRACKS},
x AS (SELECT album, track, max(CASE WHEN cum >= ceil(total::DOUBLE * (1e0 - 0.95e0)) THEN bin END) AS limit_bin
      FROM t_c GROUP BY ALL)
SELECT b.album, b.track, b.window_no, b.raw AS bin FROM b JOIN x USING (album, track)
WHERE b.raw BETWEEN 0 AND 11999 AND b.raw >= x.limit_bin
ORDER BY bin DESC, b.album, b.track, b.window_no LIMIT 20""")
def loudest_windows_top(spark, sf_dir):
    return H.loudest_windows(windows(spark, sf_dir), KEYS, top=20).select(*KEYS, "window_no", "bin")


# --- filters ------------------------------------------------------------------------------

_FIR = (0.5, -0.25, 0.125, 2.0)


@contract(f"""
WITH {SAMPLES}
SELECT album, track, n, v * 0.5e0 + coalesce(lag(v, 1) OVER o, 0) * -0.25e0 + coalesce(lag(v, 2) OVER o, 0) * 0.125e0
       + coalesce(lag(v, 3) OVER o, 0) * 2e0 AS y
FROM s WINDOW o AS (PARTITION BY album, track ORDER BY n)""")
def lagged_taps(spark, sf_dir):
    rows = indexed_samples(spark, sf_dir).select(*KEYS, "n", F.col("v").cast("double").alias("v"))
    return O.fir(rows, KEYS, "n", "v", _FIR).select(*KEYS, "n", "y")


_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 99999)
_RATE_SQL = f"{list(_RATES)}[CAST(event_id % {len(_RATES)} AS INTEGER) + 1]"


@contract(f"""
SELECT {_RATE_SQL} AS sample_rate, count(*) AS rows,
       CASE WHEN {_RATE_SQL} IN (88200, 99999) THEN 'Unsupported sample rate: ' || {_RATE_SQL} || ' Hz' END AS error,
       CASE WHEN {_RATE_SQL} NOT IN (88200, 99999) THEN 11 END AS taps
FROM events GROUP BY ALL""")
def join_coeffs(spark, sf_dir):
    rates = F.array(*[F.lit(r) for r in _RATES])
    rows = table(spark, sf_dir, "events").select(
        F.element_at(rates, (F.col("event_id") % len(_RATES) + 1).cast("int")).alias("sample_rate")
    )
    taps = F.when(F.col("ya").isNotNull(), F.size("ya"))
    return (
        FI.join_coefficients(rows).groupBy("sample_rate", "error", taps.alias("taps"))
        .agg(F.count(F.lit(1)).alias("rows")).select("sample_rate", "rows", "error", "taps")
    )


def _numbers(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


_ZERO10, _ZERO2 = _numbers([0] * 10), _numbers([0] * 2)


def filtered_sql(name: str, rate: int, where: str = "TRUE", recursive: bool = False) -> str:
    """CTEs up to z_name (track, n, z): the recursion sample by sample, with histories of ten inputs and outputs, then of two."""
    feedback, forward = C.SHAPING_FILTERS[rate]
    hp_feedback, hp_forward = C.high_pass_weights(rate)
    return f"""
{'RECURSIVE ' if recursive else ''}x_{name} AS (SELECT label AS track, list(v::DOUBLE * 32768e0 ORDER BY vec_id, pos) AS a, count(*) AS len
      FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS pos FROM embeddings WHERE {where}) GROUP BY label),
r_{name} AS (SELECT track, 0::BIGINT AS i, {_ZERO10} AS xs, {_ZERO10} AS ys, {_ZERO2} AS us, {_ZERO2} AS zs FROM x_{name}
      UNION ALL
      SELECT track, i + 1, list_prepend(v, xs[1:9]), list_prepend(y, ys[1:9]), list_prepend(y, us[1:1]), list_prepend(
             1e-10 + {hp_forward[0]!r}::DOUBLE * y + list_dot_product({_numbers(hp_forward[1:])}, us)
                   - list_dot_product({_numbers(hp_feedback)}, zs), zs[1:1])
      FROM (SELECT r.track, r.i, r.xs, r.ys, r.us, r.zs, x.a[r.i + 1] AS v,
                   1e-10 + {forward[0]!r}::DOUBLE * x.a[r.i + 1] + list_dot_product({_numbers(forward[1:])}, r.xs)
                         - list_dot_product({_numbers(feedback)}, r.ys) AS y
            FROM r_{name} AS r JOIN x_{name} AS x ON r.track = x.track AND r.i < x.len)),
z_{name} AS (SELECT track, i - 1 AS n, zs[1] AS z FROM r_{name} WHERE i > 0)"""


FILTERED = filtered_sql("all", 44100, recursive=True) + ", z AS (FROM z_all)"


@contract(f"WITH {FILTERED} SELECT track, n // 64 AS chunk, round(sum(z * z), 0) AS energy, round(max(abs(z)), 3) AS top FROM z GROUP BY ALL")
def equal_loudness_filter(spark, sf_dir):
    """Filtered samples of every packet, as energy and peak per 64 samples."""
    out = FI.equal_loudness_filter(O.packet_offsets(packets(spark, sf_dir)))
    return out.select(
        "track",
        L.int_div(F.col("first_sample"), 64).alias("chunk"),
        F.round(F.aggregate("left", F.lit(0.0), lambda a, x: a + x * x), 0).alias("energy"),
        F.round(L.array_peak(F.col("left")), 3).alias("top"),
    )


@contract(f"""
WITH {FILTERED}
SELECT track, n // 2205 AS window_no, count(*) AS samples, round(sum(2e0 * z * z) / 1e6) AS energy FROM z GROUP BY ALL""")
def exact_window_sums(spark, sf_dir):
    """Chunks of 300 samples, so that nearly every packet crosses from one into the next and states pass many borders."""
    sums = AF.exact_window_sums(O.packet_offsets(packets(spark, sf_dir)), chunk=300)
    return sums.select("track", "window_no", "samples", F.round(F.col("sum_squares") / 1e6).alias("energy"))


@contract(f"""
WITH {FILTERED},
w AS (SELECT track, n // 2205 AS window_no, sum(2e0 * z * z) AS sum_squares, count(*) AS samples FROM z GROUP BY ALL),
h AS (SELECT track, CAST(trunc(1000e0 * log10(sum_squares / samples * 0.5e0 + 1e-37)) AS INTEGER) + 2000 AS bin,
             count(*) AS cnt, 0 AS peak FROM w GROUP BY ALL),
{level_sql('h', 'track', 't')}
SELECT t.track, t.windows, t.loudness_db, {STEPS.format('t.loudness_db')} AS gain_steps, round(p.peak, 9) AS peak
FROM t JOIN (SELECT label AS track, max(list_max(list_transform(embedding, lambda e: abs(e::DOUBLE)))) AS peak
             FROM embeddings GROUP BY ALL) AS p USING (track)""")
def filtered_track_loudness(spark, sf_dir):
    """The whole chain from packets: offsets, filter, windows, histogram, percentile, peak."""
    # Packet numbers of one track are far apart in this table, so positions come first.
    placed = O.packet_offsets(packets(spark, sf_dir))
    tracks = LO.track_loudness(FI.filter_window_sums(placed), KEYS)
    return tracks.select("track", "windows", "loudness_db", "gain_steps", F.round("peak", 9).alias("peak"))


# --- packets ------------------------------------------------------------------------------


@contract("""
WITH x AS (SELECT label AS track, v::DOUBLE * 32768e0 AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS n
           FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings))
SELECT track, n // 2205 AS window_no, count(*) AS samples, round(sum(2e0 * v * v) / 1e6, 3) AS energy,
       round(max(abs(v)), 6) AS peak
FROM x GROUP BY ALL""")
def packet_window_sums(spark, sf_dir):
    """Unfiltered windows straight from packets, 50 ms at the packets' own rate."""
    sums = W.packet_window_sums(O.packet_offsets(packets(spark, sf_dir)), ["track"])
    return sums.select(
        "track", "window_no", "samples", F.round(F.col("sum_squares") / 1e6, 3).alias("energy"), F.round("peak", 6).alias("peak")
    )


def _streams(spark, sf_dir):
    left = F.when(F.col("packet_no") % 11 != 0, F.col("left"))
    stream = F.when(F.col("packet_no") % 3 == 0, 1).otherwise(0)
    return packets(spark, sf_dir).withColumn("left", left).withColumn(
        "stream_no", F.when(F.col("track") < 7, stream).otherwise(0)
    )


_STREAMS = """
p AS (SELECT label AS track, vec_id AS packet_no, CASE WHEN vec_id % 11 <> 0 THEN len(embedding) END AS size,
             CASE WHEN label < 7 AND vec_id % 3 = 0 THEN 1 ELSE 0 END AS stream_no
      FROM embeddings)"""


@contract(f"""
WITH {_STREAMS}
SELECT track, packet_no, CAST(sum(size) OVER (PARTITION BY track ORDER BY packet_no) - size AS BIGINT) AS first_sample
FROM p WHERE stream_no = 1 AND size IS NOT NULL""")
def packets_source(spark, sf_dir):
    chosen = PK.select_stream(_streams(spark, sf_dir), index=1)
    return O.packet_offsets(chosen).select("track", "packet_no", "first_sample")


@contract(f"""
WITH {_STREAMS}
SELECT track, 'error' AS status, 'Track index 1 out of range (file has ' || (max(stream_no) + 1) || ' audio track(s))' AS error
FROM p GROUP BY track HAVING max(stream_no) < 1""")
def packets_source_errors(spark, sf_dir):
    return PK.stream_errors(_streams(spark, sf_dir), index=1).select("track", "status", "error")


@contract("""
SELECT label AS track, count(*) AS packets, max(vec_id) - min(vec_id) + 1 - count(*) AS missing
FROM embeddings GROUP BY ALL""")
def packet_gaps(spark, sf_dir):
    return O.packet_gaps(packets(spark, sf_dir)).select("track", "packets", "missing")
