"""From packets to levels or errors, and everything that follows from one request table.

Packets: embeddings, with a NULL album, three sample rates (one of them unsupported), a track that changes
its rate, a track without samples, and a catalog entry without packets. Files: track 0, 4, 8 are mp4.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loudframe.contracts.roles import GAINS, LEDGER, STEPS, contract, gains, ledger, level_sql, table
from loudframe.contracts.signal import filtered_sql
from loudframe.operators import frames as FR
from loudframe.operators import ledger as LE
from loudframe.operators import measure as M
from loudframe.operators.ordered import packet_offsets
from loudframe.plans import apply as AP

_ALBUM = "CASE WHEN {0} < 3 THEN NULL WHEN {0} < 6 THEN 1 WHEN {0} < 8 THEN 2 WHEN {0} < 10 THEN 3 ELSE 4 END"
_RATE = "CASE WHEN {0} IN (2, 9) OR ({0} = 3 AND vec_id % 2 = 1) THEN 48000 WHEN {0} = 6 THEN 88200 ELSE 44100 END"


def _packets(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").selectExpr(
        f"{_ALBUM.format('label')} AS album", "label AS track", "vec_id AS packet_no", f"{_RATE.format('label')} AS sample_rate", "'F32' AS format",
        "CASE WHEN label = 8 THEN array() ELSE CAST(embedding AS array<double>) END AS left", "CAST(NULL AS array<double>) AS right")
    return packet_offsets(rows)


def _catalog(spark, sf_dir):
    tracks = table(spark, sf_dir, "embeddings").selectExpr("explode(array(label, CASE WHEN label = 7 THEN 107 END)) AS track").where("track IS NOT NULL")
    return tracks.distinct().selectExpr(f"{_ALBUM.format('track')} AS album", "track")


def _measured(spark, sf_dir, mode="failfast"):
    return M.measure(_packets(spark, sf_dir), catalog=_catalog(spark, sf_dir), mode=mode)


_MEASURED = f"""{filtered_sql("a", 44100, "label IN (0, 1, 4, 5, 7)", recursive=True)}, {filtered_sql("b", 48000, "label IN (2, 9)")},
w AS (SELECT track, n // 2205 AS window_no, sum(2e0 * z * z) AS sum_squares, count(*) AS samples FROM z_a GROUP BY ALL
      UNION ALL SELECT track, n // 2400, sum(2e0 * z * z), count(*) FROM z_b GROUP BY ALL),
e AS (SELECT label AS track, len(embedding) AS size, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak, {_RATE.format('label')} AS rate FROM embeddings),
k AS (SELECT track, min(rate) AS low, max(rate) AS high, count(*) AS packets, CAST(sum(CASE WHEN track = 8 THEN 0 ELSE size END) AS BIGINT) AS samples,
             max(CASE WHEN track = 8 THEN 0 ELSE peak END) AS peak FROM e GROUP BY track),
h AS (SELECT {_ALBUM.format('track')} AS album, track, CAST(trunc(1000e0 * log10(sum_squares / samples * 0.5e0 + 1e-37)) AS INTEGER) + 2000 AS bin,
             count(*) AS cnt, 0 AS peak FROM w GROUP BY ALL),
{level_sql('h', 'album, track', 't')},
ah AS (SELECT album, bin, CAST(sum(cnt) AS BIGINT) AS cnt, 0 AS peak FROM h GROUP BY ALL),
{level_sql('ah', 'album', 'al')},
kk AS (SELECT {_ALBUM.format('track')} AS album, track, CASE WHEN low = high THEN low END AS sample_rate, packets, samples, peak,
              CASE WHEN low <> high THEN 'Sample rate changes inside the track: ' || low || ' to ' || high || ' Hz'
                   WHEN low = 88200 THEN 'Unsupported sample rate: 88200 Hz' END AS error FROM k
       UNION ALL SELECT 4, 107, NULL, 0, 0, NULL, 'No audio track found'),
m AS (SELECT kk.album, kk.track, sample_rate, packets, samples, error, CASE WHEN error IS NULL THEN coalesce(t.windows, 0) END AS windows,
             CASE WHEN error IS NULL THEN coalesce(t.loudness_db, -20e0) END AS loudness_db, CASE WHEN error IS NULL THEN kk.peak END AS peak
      FROM kk LEFT JOIN t USING (track)),
av AS (SELECT album, count(*) AS tracks, count(error) AS failed, min(error) AS error, max(peak) AS peak FROM m GROUP BY album)"""


@contract(f"""
WITH {_MEASURED}
SELECT album, track, sample_rate, packets, samples, windows, loudness_db, {STEPS.format('loudness_db')} AS gain_steps, round(peak, 9) AS peak, error FROM m""")
def measured_tracks(spark, sf_dir):
    """One row for each track, with its level or its error."""
    tracks, _ = _measured(spark, sf_dir)
    return tracks.select("album", "track", "sample_rate", "packets", "samples", "windows", "loudness_db", "gain_steps",
                         F.round("peak", 9).alias("peak"), "error")


def _albums_sql(fine: str) -> str:
    return f"""
WITH {_MEASURED}
SELECT av.album, tracks, failed, error, CASE WHEN {fine} THEN coalesce(al.loudness_db, -20e0) END AS album_loudness_db,
       CASE WHEN {fine} THEN round(av.peak, 9) END AS album_peak
FROM av LEFT JOIN al ON al.album IS NOT DISTINCT FROM av.album"""


def _albums(spark, sf_dir, mode):
    _, albums = _measured(spark, sf_dir, mode)
    return albums.select("album", "tracks", "failed", "error", "album_loudness_db", F.round("album_peak", 9).alias("album_peak"))


@contract(_albums_sql("failed = 0"))
def measured_albums(spark, sf_dir):
    """Albums with a failed track have no level."""
    return _albums(spark, sf_dir, "failfast")


@contract(_albums_sql("failed < tracks"))
def measured_albums_permissive(spark, sf_dir):
    return _albums(spark, sf_dir, "permissive")


# --- one request table --------------------------------------------------------------------------
# The file of a track is the supplier of its number: its gain fields are lines of lineitem.


def _requests(spark, sf_dir, albums: bool, steps: int):
    tracks, levels = _measured(spark, sf_dir)
    files = tracks.withColumns({"path": F.col("track"), "kind": F.when(F.col("track") % 4 == 0, "mp4").otherwise("mp3")})
    stats = FR.gain_stats(gains(spark, sf_dir), frame=["frame_no"])
    return AP.gain_requests(files, stats, levels if albums else None, modifier_steps=steps, prevent=True)


def _requests_sql(albums: bool, steps: int) -> str:
    gain = "(64.82e0 - coalesce(al.loudness_db, -20e0))" if albums else "(64.82e0 - m.loudness_db)"
    failed = "CASE WHEN av.failed > 0 THEN 'Failed to analyze album' END" if albums else "NULL"
    return f"""{_MEASURED}, {GAINS},
st AS (SELECT path, count(DISTINCT frame_no) AS frames, min(gain) AS min_gain, max(gain) AS max_gain FROM g GROUP BY path),
r0 AS (SELECT m.album, m.track, m.track AS path, CASE WHEN m.track % 4 = 0 THEN 'mp4' ELSE 'mp3' END AS kind, m.loudness_db, 64.82e0 - m.loudness_db AS gain_db, m.peak,
              {gain if albums else 'NULL::DOUBLE'} AS album_gain_db, av.peak AS album_peak, frames, min_gain, max_gain,
              CAST(round({gain} / 1.5e0) AS INTEGER) + {steps} AS req, coalesce(m.error, {failed}) AS e0
       FROM m LEFT JOIN av ON av.album IS NOT DISTINCT FROM m.album LEFT JOIN al ON al.album IS NOT DISTINCT FROM m.album LEFT JOIN st ON st.path = m.track),
r1 AS (SELECT *, coalesce(e0, CASE WHEN kind = 'mp3' AND frames IS NULL AND req <> 0 THEN 'No valid MP3 frames found' END) AS error,
              req > 0 AND peak * pow(10e0, req * 1.5e0 / 20e0) > 1e0 AS over,
              CASE WHEN peak > 0 THEN least(req, greatest(CAST(floor(-20e0 * log10(peak) / 1.5e0) AS INTEGER), 0)) ELSE req END AS safe FROM r0),
r AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN req = 0 THEN 'skipped' ELSE 'success' END AS status,
             CASE WHEN error IS NULL THEN CASE WHEN req = 0 THEN 0 WHEN kind = 'mp4' THEN CAST(round(gain_db / 1.5e0) AS INTEGER) WHEN over THEN safe ELSE req END END AS steps FROM r1)"""


def _report_sql(albums: bool, steps: int) -> str:
    return f"""
WITH {_requests_sql(albums, steps)}
SELECT album, track, path AS file, status, CASE WHEN status = 'success' AND kind = 'mp3' AND steps <> 0 THEN frames END AS frames,
       CASE WHEN error IS NULL THEN loudness_db END AS loudness_db, steps AS gain_applied_steps,
       CASE WHEN error IS NULL THEN round(CASE WHEN req <> 0 AND kind = 'mp4' THEN gain_db ELSE steps * 1.5e0 END, 4) END AS gain_applied_db,
       CASE WHEN status = 'success' AND over THEN 'gain reduced from ' || req || ' to ' || safe || ' steps to prevent clipping (peak: ' || printf('%.4f', peak) || ')' END AS warning,
       error
FROM r"""


def _report(spark, sf_dir, albums, steps):
    out = AP.report(_requests(spark, sf_dir, albums, steps))
    return out.withColumn("gain_applied_db", F.round("gain_applied_db", 4)).drop("peak", "dry_run")


@contract(_report_sql(False, 9))
def apply_track_gains(spark, sf_dir):
    """G11 from packets: the result row of every file, failed ones included."""
    return _report(spark, sf_dir, False, 9)


@contract(_report_sql(True, 8))
def apply_album_gains(spark, sf_dir):
    """G12 from packets: a failed track fails its album's files."""
    return _report(spark, sf_dir, True, 8)


@contract(f"""
WITH {_requests_sql(True, 8)}
SELECT g.path, count(DISTINCT frame_no) AS frames, count(*) AS fields, CAST(count_if(gain <> least(255, greatest(0, gain + steps))) AS BIGINT) AS changed,
       CAST(sum(least(255, greatest(0, gain + steps))) AS BIGINT) AS total
FROM g JOIN r ON r.path = g.path AND r.status = 'success' AND r.kind = 'mp3' AND r.steps <> 0 GROUP BY g.path""")
def apply_patches(spark, sf_dir):
    """The patch plan of the same requests."""
    plan = AP.patches(_requests(spark, sf_dir, True, 8), gains(spark, sf_dir))
    return plan.groupBy("path").agg(
        F.count_distinct("frame_no").alias("frames"), F.count(F.lit(1)).alias("fields"), F.count_if(F.col("old") != F.col("new")).alias("changed"),
        F.sum("new").alias("total"))


@contract(f"""
WITH {_requests_sql(True, 8)}
SELECT path, CAST(path + 5000 AS BIGINT) AS id, CAST(NULL AS INTEGER) AS channel, steps, FALSE AS wrap, min_gain, max_gain
FROM r WHERE status = 'success' AND kind = 'mp3' AND steps <> 0""")
def apply_ledger(spark, sf_dir):
    """The ledger entries of the same requests."""
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return AP.ledger_rows(_requests(spark, sf_dir, True, 8), ts, F.col("path") + 5000).select("path", "id", "channel", "steps", "wrap", "min_gain", "max_gain")


@contract(f"""
WITH {_requests_sql(True, 8)}, {LEDGER},
before AS (SELECT path, CAST(sum(CASE WHEN channel IS NULL OR channel = 0 THEN steps ELSE 0 END) AS BIGINT) AS lu,
                  CAST(sum(CASE WHEN channel IS NULL OR channel = 1 THEN steps ELSE 0 END) AS BIGINT) AS ru,
                  first(min_gain || ',' || max_gain ORDER BY ts, id) FILTER (WHERE min_gain IS NOT NULL) AS minmax FROM l GROUP BY path),
done AS (SELECT r.*, coalesce(lu, 0) + steps AS lu, coalesce(ru, 0) + steps AS ru, coalesce(minmax, min_gain || ',' || max_gain) AS span
         FROM r LEFT JOIN before ON before.path = r.path WHERE status = 'success')
SELECT path, CAST(pos AS INTEGER) AS pos, key, value FROM (
  SELECT path, 0 AS pos, 'MP3GAIN_UNDO' AS key, printf('%+04d,%+04d,N', lu, ru) AS value FROM done WHERE kind = 'mp3' AND steps <> 0
  UNION ALL SELECT path, 1, 'MP3GAIN_MINMAX', span FROM done WHERE kind = 'mp3' AND steps <> 0
  UNION ALL SELECT path, 0, 'REPLAYGAIN_TRACK_GAIN', printf('%+.2f dB', gain_db) FROM done WHERE kind = 'mp4'
  UNION ALL SELECT path, 1, 'REPLAYGAIN_TRACK_PEAK', printf('%.6f', peak) FROM done WHERE kind = 'mp4'
  UNION ALL SELECT path, 2, 'REPLAYGAIN_ALBUM_GAIN', printf('%+.2f dB', album_gain_db) FROM done WHERE kind = 'mp4'
  UNION ALL SELECT path, 3, 'REPLAYGAIN_ALBUM_PEAK', printf('%.6f', album_peak) FROM done WHERE kind = 'mp4')
WHERE value IS NOT NULL""")
def apply_tags(spark, sf_dir):
    """The tag rows of the same requests; undo values go on from the ledger so far."""
    before = LE.ledger_state(ledger(spark, sf_dir))
    return AP.tag_rows(_requests(spark, sf_dir, True, 8), before)
