"""Tag values, tag lists, tag tables and the tag jobs on file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loudframe import constants as C
from loudframe.contracts.frames import _be32, _join, _le32, _text, _zeros
from loudframe.contracts.roles import KEYS, TAGS, TRACKS, contract, directory, spread, table, tags, windows
from loudframe.functions import tags as T
from loudframe.operators import loudness as LO
from loudframe.operators import tagtables as TT
from loudframe.plans import reports as RP
from loudframe.sources import files as FS


def _lists(spark, sf_dir):
    """Tag lists per document: keys in mixed case, one of them twice."""
    def item(key, value) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    items = F.array(
        item("Mood", F.col("lang")), item("MP3GAIN_UNDO", F.format_string("%+04d,%+04d,N", F.col("doc_id") % 9, F.col("doc_id") % 5)),
        item("mood", F.col("source")),
    )
    items = F.when(F.col("doc_id") % 4 == 0, F.slice(items, 2, 1)).otherwise(items)
    return table(spark, sf_dir, "documents").select("doc_id", items.alias("items"))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t: F.concat(t["key"], F.lit("="), t["value"])), ";")


_UNDO = "'MP3GAIN_UNDO=' || printf('%+04d,%+04d,N', doc_id % 9, doc_id % 5)"


@contract("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS mood FROM documents")
def tag_get(spark, sf_dir):
    return _lists(spark, sf_dir).select("doc_id", T.tag_get(F.col("items"), "MOOD").alias("mood"))


@contract(f"WITH {TAGS} SELECT path, arg_min(value, pos) AS value FROM t4 WHERE upper(key) = 'LANGUAGE' GROUP BY path")
def tag_lookup(spark, sf_dir):
    return TT.lookup_tag(tags(spark, sf_dir), "language")


@contract(f"""
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Mood=calm;' || {_UNDO} || ';mood=' || source
                    ELSE {_UNDO} || ';MOOD=calm' END AS items FROM documents""")
def tag_set(spark, sf_dir):
    return _lists(spark, sf_dir).select("doc_id", _joined(T.tag_set(F.col("items"), "mood", F.lit("calm"))).alias("items"))


@contract(f"SELECT doc_id, {_UNDO} AS items, FALSE AS empty, doc_id % 4 = 0 AS empty_without_undo FROM documents")
def tag_remove(spark, sf_dir):
    left = T.tag_remove(F.col("items"), "MOOD")
    return _lists(spark, sf_dir).select(
        "doc_id", _joined(left).alias("items"), T.tag_is_empty(left).alias("empty"),
        T.tag_is_empty(T.tag_remove(F.col("items"), "mp3gain_undo")).alias("empty_without_undo"),
    )


@contract("""
SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 3 THEN 0 ELSE doc_id % 9 - 4 END AS INTEGER) AS left,
       CAST(CASE doc_id % 5 WHEN 0 THEN doc_id % 7 - 3 WHEN 1 THEN doc_id % 9 - 4 WHEN 2 THEN doc_id % 9 - 4
                            WHEN 3 THEN doc_id % 7 - 3 ELSE doc_id % 9 - 4 END AS INTEGER) AS right,
       CAST(CASE WHEN doc_id % 5 <> 3 THEN doc_id % 9 - 4 END AS INTEGER) AS steps
FROM documents""")
def parse_undo(spark, sf_dir):
    left, right = F.col("doc_id") % 9 - 4, F.col("doc_id") % 7 - 3
    text = (
        F.when(F.col("doc_id") % 5 == 0, F.format_string("%+04d,%+04d,N", left, right))
        .when(F.col("doc_id") % 5 == 1, F.format_string("%+04d", left))
        .when(F.col("doc_id") % 5 == 2, F.format_string(" %d , x", left))
        .when(F.col("doc_id") % 5 == 3, F.format_string("1.5,%d,W", right))
        .otherwise(F.format_string("%d,", left))
    )
    u = T.parse_undo(text)
    return table(spark, sf_dir, "documents").select(
        "doc_id", u["left"].alias("left"), u["right"].alias("right"), T.undo_steps(text).alias("steps")
    )


@contract("""
SELECT doc_id, printf('%+04d,%+04d,', doc_id % 19 - 9, doc_id % 300 - 150) || CASE WHEN doc_id % 2 = 0 THEN 'W' ELSE 'N' END AS undo
FROM documents""")
def format_undo(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.format_undo(d % 19 - 9, d % 300 - 150, d % 2 == 0).alias("undo"))


@contract("SELECT doc_id, (doc_id % 100) || ',' || (doc_id % 100 + 100) AS minmax FROM documents")
def format_minmax(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", T.format_minmax(d % 100, d % 100 + 100).alias("minmax"))


@contract("""
SELECT event_id, printf('%+.2f dB', (value - 250e0) / 3e0) AS gain, printf('%.6f', value / 333e0) AS peak FROM events""")
def format_gain_tag(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        T.format_gain_tag((F.col("value") - 250) / 3).alias("gain"),
        T.format_peak_tag(F.col("value") / 333).alias("peak"),
    )


@contract(f"""
WITH {TAGS}
SELECT path, pos, TRY_CAST(regexp_extract(value, '([+-]?[0-9.]+)', 1) AS DOUBLE) AS number FROM t4""")
def parse_gain_tag(spark, sf_dir):
    return tags(spark, sf_dir).select("path", "pos", T.parse_gain_tag(F.col("value")).alias("number"))


# --- tag tables -----------------------------------------------------------------------------

_COLS = """
c AS (SELECT path, first(value ORDER BY pos) FILTER (WHERE upper(key) = 'MP3GAIN_UNDO') AS mp3gain_undo,
             first(value ORDER BY pos) FILTER (WHERE upper(key) = 'MP3GAIN_MINMAX') AS mp3gain_minmax,
             first(value ORDER BY pos) FILTER (WHERE upper(key) = 'REPLAYGAIN_TRACK_GAIN') AS replaygain_track_gain,
             first(value ORDER BY pos) FILTER (WHERE upper(key) = 'REPLAYGAIN_TRACK_PEAK') AS replaygain_track_peak,
             first(value ORDER BY pos) FILTER (WHERE upper(key) = 'REPLAYGAIN_ALBUM_GAIN') AS replaygain_album_gain,
             first(value ORDER BY pos) FILTER (WHERE upper(key) = 'REPLAYGAIN_ALBUM_PEAK') AS replaygain_album_peak
      FROM t4 GROUP BY path)"""
_SIX = ["mp3gain_undo", "mp3gain_minmax", "replaygain_track_gain", "replaygain_track_peak", "replaygain_album_gain",
        "replaygain_album_peak"]
_DASHED = ", ".join(f"coalesce({c}, '-') AS {c}" for c in _SIX)


@contract(f"WITH {TAGS}, {_COLS} SELECT path, {_DASHED} FROM c")
def tag_columns(spark, sf_dir):
    return TT.dashed(TT.tag_columns(tags(spark, sf_dir)))


@contract(f"""
WITH {TAGS}, {_COLS}
SELECT doc_id AS path, c.path IS NOT NULL AS has_tag, c.mp3gain_undo, c.replaygain_track_gain
FROM documents LEFT JOIN c ON c.path = doc_id""")
def join_tags(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    joined = TT.join_tags(files, TT.tag_columns(tags(spark, sf_dir)))
    return joined.select("path", "has_tag", "mp3gain_undo", "replaygain_track_gain")


def _updates(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("path"))
    return chosen.select(
        "path", F.lit("APEv2").alias("namespace"), F.lit(0).alias("pos"),
        F.lit("REPLAYGAIN_ALBUM_GAIN").alias("key"), T.format_gain_tag((F.col("path") % 64) / 8).alias("value"),
    )


_LEVEL_KEYS = "('REPLAYGAIN_TRACK_GAIN', 'REPLAYGAIN_TRACK_PEAK', 'REPLAYGAIN_ALBUM_GAIN', 'REPLAYGAIN_ALBUM_PEAK')"
_UPDATES = """
u AS (SELECT doc_id AS path, 'APEv2' AS namespace, 0 AS pos, 'REPLAYGAIN_ALBUM_GAIN' AS key,
             printf('%+.2f dB', (doc_id % 64) / 8e0) AS value FROM labels WHERE quality = 1)"""


@contract(f"""
WITH {TAGS}, {_UPDATES}
SELECT * FROM t4 WHERE NOT (upper(key) IN {_LEVEL_KEYS} AND (path, namespace) IN (SELECT (path, namespace) FROM u)) UNION ALL SELECT * FROM u""")
def merge_tag_rows(spark, sf_dir):
    return TT.merge_tag_rows(tags(spark, sf_dir), _updates(spark, sf_dir))


@contract(f"""
WITH {TAGS}, {_UPDATES}
SELECT * FROM t4 WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.path = t4.path AND u.namespace = t4.namespace AND upper(u.key) = upper(t4.key)) UNION ALL SELECT * FROM u""")
def merge_tag_rows_keep(spark, sf_dir):
    return TT.merge_tag_rows(tags(spark, sf_dir), _updates(spark, sf_dir), keep_missing=True)


@contract(f"WITH {TAGS} SELECT * FROM t4 WHERE path NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_tags(spark, sf_dir):
    files = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("path"))
    return TT.delete_tags(tags(spark, sf_dir), files)


@contract(f"""WITH {TAGS} SELECT * FROM t4
WHERE NOT (namespace = 'com.apple.iTunes' AND upper(key) IN {_LEVEL_KEYS} AND path IN (SELECT doc_id FROM labels WHERE toxic = 1))""")
def delete_level_tags(spark, sf_dir):
    files = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("path"))
    return TT.delete_tags(tags(spark, sf_dir), files, namespace=C.MP4_NAMESPACE, keys=C.LEVEL_KEYS)


@contract(f"""
WITH {TAGS}
SELECT doc_id AS path, (SELECT count(*) FROM t4 WHERE t4.path = doc_id) AS removed, 'success' AS status FROM labels WHERE toxic = 1""")
def delete_report(spark, sf_dir):
    files = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("path"))
    return TT.delete_report(files, tags(spark, sf_dir))


@contract(f"""
WITH {TAGS}, {TRACKS},
v AS (SELECT track AS path, 'com.apple.iTunes' AS namespace, n.pos, n.key, n.value
      FROM t, LATERAL (VALUES (0, 'REPLAYGAIN_TRACK_GAIN', printf('%+.2f dB', 64.82e0 - loudness_db)),
                              (1, 'REPLAYGAIN_TRACK_PEAK', printf('%.6f', peak / 3e0))) AS n(pos, key, value))
SELECT * FROM t4 WHERE NOT (upper(key) IN {_LEVEL_KEYS} AND (path, namespace) IN (SELECT (path, namespace) FROM v)) UNION ALL SELECT * FROM v""")
def upsert_tags(spark, sf_dir):
    tracks = LO.track_loudness(windows(spark, sf_dir), KEYS)
    lists = tracks.select(F.col("track").alias("path"), T.level_tags(F.col("gain_db"), F.col("peak") / 3).alias("items"))
    return TT.upsert_level_tags(tags(spark, sf_dir), lists)


@contract(f"""
WITH {TAGS}, {_COLS}
SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN c.path IS NULL THEN 'no_tag' ELSE 'success' END AS status, {_DASHED}
FROM documents LEFT JOIN c ON c.path = doc_id""")
def tag_report(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    out = RP.tag_report(TT.join_tags(files, TT.tag_columns(tags(spark, sf_dir))))
    return out.withColumn("file", F.col("file").cast("string"))


# --- file contents ----------------------------------------------------------------------------


def _utf8(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def _tagged_documents(spark, sf_dir):
    """Documents with a trailing APEv2 tag: three items, some without a tag or with an old version."""
    d = F.col("doc_id")

    def item(key: str, value: Column) -> Column:
        return _join(_le32(F.octet_length(value)), _zeros(4), _text(key), _zeros(1), _utf8(value))

    items = _join(item("Language", F.col("lang")), item("SOURCE", F.col("source")), item("Text", F.col("text")))
    version = F.when(d % 7 == 0, 1000).otherwise(2000)
    size = F.length("items") + 32
    footer = _join(_text("APETAGEX"), _le32(version), _le32(size), _le32(F.lit(3)), _zeros(12))
    content = _join(_utf8(F.col("text")), F.when(d % 5 != 0, _join(F.col("items"), footer)), F.when(d % 3 == 0, F.lit(b"TAG" + bytes(125))))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), directory(d))
    return docs.withColumn("items", items).select(d.cast("string").alias("path"), content.alias("content"))


@contract("""
SELECT CAST(doc_id AS VARCHAR) AS path, 'APEv2' AS namespace, u.pos, u.key, u.value
FROM documents, LATERAL (VALUES (0, 'Language', lang), (1, 'SOURCE', source), (2, 'Text', text)) AS u(pos, key, value)
WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def ape_tags_job(spark, sf_dir):
    return FS.ape_tag_rows(_tagged_documents(spark, sf_dir))


def _boxed_documents(spark, sf_dir):
    """Documents inside an mp4 box tree with freeform tags, one of them in a foreign namespace."""
    d = F.col("doc_id")

    def box(kind: str, *body: Column) -> Column:
        inner = _join(*body)
        return _join(_be32(F.length(inner) + 8), _text(kind), inner)

    def free(space: str, key: str, value: Column) -> Column:
        return box("----", box("mean", _zeros(4), _text(space)), box("name", _zeros(4), _text(key)),
                   box("data", F.lit(b"\0\0\0\1\0\0\0\0"), _utf8(value)))

    ilst = _join(
        free("com.apple.iTunes", "replaygain_track_gain", F.col("source")),
        free("com.apple.iTunes", "REPLAYGAIN_ALBUM_PEAK", F.col("lang")),
        free("org.example", "replaygain_track_peak", F.lit("x")),
        free("com.apple.iTunes", "encoder", F.lit("y")),
        F.when(d % 3 == 0, free("com.apple.iTunes", "replaygain_track_gain", F.lit("newer"))),
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), directory(d)).withColumn("tags", ilst)
    docs = docs.withColumn("meta", box("meta", _zeros(4), box("hdlr", _zeros(4)), box("ilst", F.col("tags"))))
    moov = box("moov", box("mvhd", _zeros(8)), box("udta", F.col("meta")))
    content = _join(box("ftyp", _text("M4A isom")), box("mdat", _utf8(F.col("text"))), F.when(d % 4 != 0, moov))
    return docs.select(d.cast("string").alias("path"), content.alias("content"))


@contract("""
SELECT CAST(doc_id AS VARCHAR) AS path, 'com.apple.iTunes' AS namespace, u.pos, u.key, u.value
FROM documents, LATERAL (VALUES (0, 'replaygain_track_gain', CASE WHEN doc_id % 3 = 0 THEN 'newer' ELSE source END),
                                (1, 'replaygain_album_peak', lang)) AS u(pos, key, value)
WHERE doc_id % 4 <> 0""")
def mp4_tags_job(spark, sf_dir):
    return FS.mp4_tag_rows(_boxed_documents(spark, sf_dir))
