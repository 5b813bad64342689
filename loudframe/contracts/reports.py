"""Statuses, summaries and the composed reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loudframe.contracts.roles import (
    ALBUMS, FRAME_GAINS, KEYS, STEPS, TRACKS, contract, frames, gains, results, table, windows,
)
from loudframe.functions.report import status_of
from loudframe.operators import frames as FR
from loudframe.operators import loudness as LO
from loudframe.plans import reports as RP
from loudframe.session import fresh_path
from loudframe.sources import sinks as SK

_STATUS = """
s AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'error' WHEN quality IS NULL THEN 'no_tag'
             WHEN quality = 0 THEN 'skipped' ELSE 'success' END AS status,
             CASE WHEN toxic = 1 THEN 'toxic' END AS error
      FROM documents LEFT JOIN labels USING (doc_id))"""


def _statuses(spark, sf_dir):
    error = F.when(F.col("toxic") == 1, F.lit("toxic"))
    status = status_of(error=error, tag=F.col("quality"), steps=F.col("quality"))
    return results(spark, sf_dir).select("doc_id", "source", status.alias("status"), error.alias("error"))


@contract(f"WITH {_STATUS} SELECT doc_id, status FROM s")
def status_words(spark, sf_dir):
    return _statuses(spark, sf_dir).select("doc_id", "status")


@contract(f"""
WITH {_STATUS}
SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'success') AS successful,
       count(*) FILTER (WHERE status = 'error') AS failed, TRUE AS dry_run FROM s""")
def batch_summary(spark, sf_dir):
    return RP.batch_summary(_statuses(spark, sf_dir), dry_run=True)


@contract(f"""
WITH {_STATUS}
SELECT '{{"file":"' || doc_id || '","status":"' || status || '"' || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END
       || '}}' AS value
FROM s""")
def json_sink(spark, sf_dir):
    rows = _statuses(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), "status", "error")
    return SK.json_rows(rows)


@contract(f"""
WITH {_STATUS}
SELECT '{{"file":"' || doc_id || '","status":"' || status || '"' || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END || '}}' AS value,
       CAST(doc_id AS VARCHAR) = (SELECT min(CAST(doc_id AS VARCHAR)) FROM s) AS opens
FROM s
UNION ALL SELECT '{{"files":[', FALSE UNION ALL SELECT '],"albums":[', FALSE UNION ALL SELECT '],', FALSE
UNION ALL SELECT '{{"source":"' || source || '","files":' || count(*) || '}}', source = (SELECT min(source) FROM s) FROM s GROUP BY source
UNION ALL SELECT '"summary":{{"total_files":' || count(*) || ',"successful":' || count(*) FILTER (WHERE status = 'success') || ',"failed":'
       || count(*) FILTER (WHERE status = 'error') || '}}}}', FALSE FROM s""")
def json_document_parts(spark, sf_dir):
    """The lines of one JSON document over many parts; every row but the first of a list brings its comma."""
    rows = _statuses(spark, sf_dir)
    files = rows.select(F.col("doc_id").cast("string").alias("file"), "status", "error")
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    target = f"{fresh_path(spark, 'document')}/json"
    SK.write_json_document(files, RP.batch_summary(rows), target, album=sources, rows_per_part=100)
    opens = F.col("value").startswith("{") & ~F.col("value").startswith('{"files":[')
    return spark.read.text(target).select(F.regexp_replace("value", "^,", "").alias("value"), opens.alias("opens"))


@contract(f"WITH {_STATUS} SELECT doc_id, status, error FROM s")
def report_json(spark, sf_dir):
    """There and back: rows to JSON text and from JSON text."""
    rows = SK.json_rows(_statuses(spark, sf_dir).select("doc_id", "status", "error"))
    back = F.from_json("value", "doc_id bigint, status string, error string")
    return rows.select(back.alias("r")).select("r.*")


# --- loudness reports -------------------------------------------------------------------------
# A track's file is '<track>.mp3', every fourth one '<track>.m4a'; full scale is 40,000 cents.

_FULL = 40000.0


def _levels(spark, sf_dir):
    tracks, albums = LO.level_tables(windows(spark, sf_dir), KEYS, ["album"])
    return _as_files(tracks), albums.withColumn("album_peak", F.col("album_peak") / F.lit(_FULL))


def _as_files(tracks):
    kind = F.when(F.col("track") % 4 == 0, "mp4").otherwise("mp3")
    suffix = F.when(F.col("track") % 4 == 0, ".m4a").otherwise(".mp3")
    return tracks.select(
        *KEYS, F.concat(F.col("track").cast("string"), suffix).alias("file"), kind.alias("kind"), "loudness_db", "gain_db",
        (F.col("peak") / F.lit(_FULL)).alias("peak"), F.col("windows").alias("frames"),
        F.when(F.col("track") % 50 == 7, F.lit("broken")).alias("error"),
    )


def _tracks(spark, sf_dir):
    return _as_files(LO.track_loudness(windows(spark, sf_dir), KEYS))


_FILES = """
x AS (SELECT t.album, t.track, t.track || CASE WHEN t.track % 4 = 0 THEN '.m4a' ELSE '.mp3' END AS file,
             CASE WHEN t.track % 4 = 0 THEN 'mp4' ELSE 'mp3' END AS kind, t.loudness_db, 64.82e0 - t.loudness_db AS gain_db,
             t.peak / 40000e0 AS peak, t.windows AS frames, CASE WHEN t.track % 50 = 7 THEN 'broken' END AS error
      FROM t)"""


def _apply_sql(source: str) -> str:
    """Result rows from ``source`` with the columns of x and ``req``, the requested steps."""
    return f"""
y AS (SELECT *, req > 0 AND peak * pow(10e0, req * 1.5e0 / 20e0) > 1e0 AS over,
             least(req, greatest(CAST(floor(-20e0 * log10(peak) / 1.5e0) AS INTEGER), 0)) AS safe FROM {source}),
z AS (SELECT *, CASE WHEN req = 0 THEN 0 WHEN kind = 'mp4' THEN CAST(round(gain_db / 1.5e0) AS INTEGER)
                     WHEN over THEN safe ELSE req END AS done FROM y)
SELECT file, CASE WHEN error IS NOT NULL THEN 'error' WHEN req = 0 THEN 'skipped' ELSE 'success' END AS status,
       CASE WHEN error IS NULL AND req <> 0 AND kind = 'mp3' AND done <> 0 THEN frames END AS frames,
       CASE WHEN error IS NULL THEN loudness_db END AS loudness_db,
       CASE WHEN error IS NULL THEN done END AS gain_applied_steps,
       CASE WHEN error IS NULL THEN round(CASE WHEN req <> 0 AND kind = 'mp4' THEN gain_db ELSE done * 1.5e0 END, 4) END AS gain_applied_db,
       CASE WHEN error IS NULL AND req <> 0 AND over THEN 'gain reduced from ' || req || ' to ' || safe
            || ' steps to prevent clipping (peak: ' || printf('%.4f', peak) || ')' END AS warning,
       error
FROM z"""


_APPLIED = ["file", "status", "frames", "loudness_db", "gain_applied_steps", "gain_applied_db", "warning", "error"]


@contract(f"WITH {TRACKS}, {_FILES}, rq AS (SELECT *, CAST(round(gain_db / 1.5e0) AS INTEGER) + 14 AS req FROM x), {_apply_sql('rq')}")
def track_gain_report(spark, sf_dir):
    out = RP.track_gain_report(_tracks(spark, sf_dir), modifier_steps=14, prevent=True)
    return out.withColumn("gain_applied_db", F.round("gain_applied_db", 4)).select(*_APPLIED)


@contract(f"""
WITH {ALBUMS}, {_FILES},
rq AS (SELECT x.*, {STEPS.format('a.loudness_db')} + 13 AS req FROM x JOIN a ON x.album = a.album),
{_apply_sql('rq')}""")
def album_gain_report(spark, sf_dir):
    out = RP.album_gain_report(*_levels(spark, sf_dir), modifier_steps=13, prevent=True)
    return out.withColumn("gain_applied_db", F.round("gain_applied_db", 4)).select(*_APPLIED)


_MEASURES = f"""{_FILES},
m AS (SELECT l_suppkey AS path, CAST(trunc(min(l_quantity) * 5) AS INTEGER) AS min_gain, CAST(trunc(max(l_quantity) * 5) AS INTEGER) AS max_gain
      FROM lineitem GROUP BY 1)"""


def _measures(spark, sf_dir):
    fields = FR.gain_minmax(gains(spark, sf_dir)).withColumnRenamed("path", "track").withColumn(
        "max_amplitude", F.lit(0.5)
    )
    return FR.join_measures(_tracks(spark, sf_dir), fields, "track")


@contract(f"""
WITH {TRACKS}, {_MEASURES}
SELECT file, coalesce(max_gain, 255) AS max_gain, coalesce(min_gain, 0) AS min_gain,
       CASE WHEN m.path IS NULL THEN 1e0 ELSE 0.5e0 END AS max_amplitude
FROM x LEFT JOIN m ON x.track = m.path""")
def join_measures(spark, sf_dir):
    return _measures(spark, sf_dir).select("file", "max_gain", "min_gain", "max_amplitude")


@contract(f"""
WITH {TRACKS}, {_MEASURES}
SELECT file AS "File", CAST(CAST(round((gain_db + 1.5e0) / 1.5e0) AS INTEGER) AS VARCHAR) AS "MP3 gain",
       printf('%.6f', gain_db + 1.5e0) AS "dB gain", printf('%.6f', peak * 32768e0) AS "Max Amplitude",
       CAST(coalesce(max_gain, 255) AS VARCHAR) AS "Max global_gain", CAST(coalesce(min_gain, 0) AS VARCHAR) AS "Min global_gain"
FROM x LEFT JOIN m ON x.track = m.path""")
def tsv_sink(spark, sf_dir):
    return SK.level_rows(_measures(spark, sf_dir), modifier_db=1.5)


@contract(f"""
WITH {TRACKS}, {_MEASURES}
SELECT file, CASE WHEN error IS NOT NULL THEN 'error' END AS status,
       CASE WHEN error IS NULL THEN round(peak * 32768e0, 6) END AS max_amplitude,
       CASE WHEN error IS NULL THEN round(-20e0 * log10(peak), 6) END AS headroom_db,
       CASE WHEN error IS NULL THEN coalesce(max_gain, 255) END AS max_gain,
       CASE WHEN error IS NULL THEN coalesce(min_gain, 0) END AS min_gain,
       CASE WHEN error IS NULL AND kind = 'mp3' AND peak >= 0.9999e0 THEN 'peak may be clipped - actual value could be higher' END AS warning,
       error
FROM x LEFT JOIN m ON x.track = m.path""")
def max_amplitude_report(spark, sf_dir):
    out = RP.max_amplitude_report(_measures(spark, sf_dir))
    return out.withColumns({"max_amplitude": F.round("max_amplitude", 6), "headroom_db": F.round("headroom_db", 6)})


@contract(f"""
WITH {FRAME_GAINS},
st AS (SELECT path, count(DISTINCT frame_no) AS frames, first(mpeg_version ORDER BY frame_offset, gr, ch) AS mpeg_version,
              first(channel_mode ORDER BY frame_offset, gr, ch) AS channel_mode, min(gain) AS min_gain, max(gain) AS max_gain,
              round(sum(gain)::DOUBLE / count(*), 6) AS avg_gain FROM q GROUP BY path),
c AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 10 = 3 THEN 'mp4' ELSE 'mp3' END AS kind FROM customer)
SELECT CAST(c.path AS VARCHAR) AS file, CASE WHEN kind = 'mp4' THEN 'info' WHEN frames IS NULL THEN 'error' END AS status,
       CASE WHEN kind = 'mp3' THEN frames END AS frames, CASE WHEN kind = 'mp3' THEN mpeg_version END AS mpeg_version,
       CASE WHEN kind = 'mp3' THEN channel_mode END AS channel_mode, CASE WHEN kind = 'mp3' THEN min_gain END AS min_gain,
       CASE WHEN kind = 'mp3' THEN max_gain END AS max_gain, CASE WHEN kind = 'mp3' THEN avg_gain END AS avg_gain,
       CASE WHEN kind = 'mp3' THEN 255 - max_gain END AS headroom_steps,
       CASE WHEN kind = 'mp3' THEN (255 - max_gain) * 1.5e0 END AS headroom_db,
       CASE WHEN kind = 'mp3' AND frames IS NULL THEN 'No valid MP3 frames found' END AS error
FROM c LEFT JOIN st USING (path)""")
def info_report(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("path"), F.when(F.col("c_custkey") % 10 == 3, "mp4").otherwise("mp3").alias("kind")
    )
    stats = FR.frame_stats(FR.valid_frames(frames(spark, sf_dir)))
    out = RP.info_report(files, stats)
    return out.withColumns({"file": F.col("file").cast("string"), "avg_gain": F.round("avg_gain", 6)})


@contract(f"""
WITH {ALBUMS}, {_FILES}
SELECT x.album, x.track, CASE WHEN error IS NULL THEN round(89e0 - gain_db, 4) END AS volume,
       CASE WHEN error IS NULL THEN x.peak >= 1e0 END AS clipping,
       CASE WHEN error IS NULL THEN round(104e0 - 89e0 + gain_db, 4) END AS track_gain,
       CASE WHEN error IS NULL THEN x.peak * pow(10e0, (104e0 - 89e0 + gain_db) / 20e0) > 1e0 END AS track_clip,
       round(89e0 - (64.82e0 - a.loudness_db), 4) AS album_volume,
       round(104e0 - 89e0 + (64.82e0 - a.loudness_db), 4) AS album_gain,
       a.peak / 40000e0 * pow(10e0, (104e0 - 89e0 + (64.82e0 - a.loudness_db)) / 20e0) > 1e0 AS album_clip,
       CASE WHEN error IS NULL THEN 'analyzed' ELSE 'error' END AS status
FROM x JOIN a ON x.album = a.album""")
def loudness_table(spark, sf_dir):
    out = RP.loudness_table(*_levels(spark, sf_dir), target_db=104.0)
    return out.withColumns({c: F.round(c, 4) for c in ("volume", "track_gain", "album_volume", "album_gain")})
