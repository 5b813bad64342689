"""Headers, frames, files, gain fields and plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loudframe.contracts.roles import (
    FRAME_GAINS, FRAMES, GAINS, PATHS, REQUESTS, contract, frames, gain_requests, gains, paths, spread, table,
)
from loudframe.functions import gains as G
from loudframe.functions import headers as HD
from loudframe.functions import paths as P
from loudframe.operators import frames as FR
from loudframe.operators.ordered import sample_index
from loudframe.plans import gain_plan as GP
from loudframe.sources import catalog as CA
from loudframe.sources import files as FS

# --- headers ------------------------------------------------------------------------------


@contract(f"""
WITH {FRAMES}
SELECT frame_no, mpeg_version, layer, has_crc, CAST(bitrate_kbps AS INTEGER) AS bitrate_kbps,
       CAST(sample_rate AS INTEGER) AS sample_rate, padding, channel_mode
FROM k""")
def decode_header(spark, sf_dir):
    cols = ["mpeg_version", "layer", "has_crc", "bitrate_kbps", "sample_rate", "padding", "channel_mode"]
    return FR.decode_frames(frames(spark, sf_dir)).select("frame_no", *cols)


@contract(f"WITH {FRAMES} SELECT path, frame_no FROM k WHERE valid")
def valid_header(spark, sf_dir):
    return FR.valid_frames(frames(spark, sf_dir)).select("path", "frame_no")


@contract(f"WITH {FRAMES} SELECT frame_no, frame_size FROM k WHERE valid")
def frame_size(spark, sf_dir):
    return FR.decode_frames(FR.valid_frames(frames(spark, sf_dir))).select("frame_no", "frame_size")


@contract(f"WITH {FRAME_GAINS} SELECT path, frame_no, gr, ch, byte_offset, bit_offset FROM q")
def gain_locations(spark, sf_dir):
    return FR.gain_rows(FR.valid_frames(frames(spark, sf_dir))).drop("gain")


@contract(f"WITH {FRAME_GAINS} SELECT path, frame_no, gr, ch, gain FROM q")
def read_gain(spark, sf_dir):
    return FR.gain_rows(FR.valid_frames(frames(spark, sf_dir))).select("path", "frame_no", "gr", "ch", "gain")


@contract(f"""
WITH {FRAMES}
SELECT mpeg_version, CAST(bitrate_kbps AS INTEGER) AS bitrate_kbps, CAST(sample_rate AS INTEGER) AS sample_rate, count(*) AS frames
FROM k WHERE valid GROUP BY ALL""")
def join_format_tables(spark, sf_dir):
    rows = FR.join_format_tables(FR.valid_frames(frames(spark, sf_dir)).select("header_word"))
    return rows.groupBy("mpeg_version", "bitrate_kbps", "sample_rate").agg(F.count(F.lit(1)).alias("frames"))


_FIRST = "first(mpeg_version ORDER BY frame_offset, gr, ch) AS mpeg_version, first(channel_mode ORDER BY frame_offset, gr, ch) AS channel_mode"


@contract(f"""
WITH {FRAME_GAINS}
SELECT path, count(DISTINCT frame_no) AS frames, {_FIRST}, min(gain) AS min_gain, max(gain) AS max_gain,
       round(sum(gain)::DOUBLE / count(*), 6) AS avg_gain, 255 - max(gain) AS headroom_steps,
       (255 - max(gain)) * 1.5e0 AS headroom_db
FROM q GROUP BY path""")
def frame_stats(spark, sf_dir):
    return FR.frame_stats(FR.valid_frames(frames(spark, sf_dir))).withColumn("avg_gain", F.round("avg_gain", 6))


@contract(f"""
WITH {GAINS}
SELECT path, count(DISTINCT frame_no) AS frames, min(gain) AS min_gain, max(gain) AS max_gain,
       round(sum(gain)::DOUBLE / count(*), 6) AS avg_gain, 255 - max(gain) AS headroom_steps,
       (255 - max(gain)) * 1.5e0 AS headroom_db
FROM g GROUP BY path""")
def gain_stats(spark, sf_dir):
    return FR.gain_stats(gains(spark, sf_dir), frame=["frame_no"]).withColumn("avg_gain", F.round("avg_gain", 6))


@contract(f"""
WITH {GAINS}
SELECT path, count(*) FILTER (WHERE gr = 0 AND ch = 0) AS frames, min(gain) AS min_gain, max(gain) AS max_gain,
       round(sum(gain)::DOUBLE / count(*), 6) AS avg_gain, 255 - max(gain) AS headroom_steps,
       (255 - max(gain)) * 1.5e0 AS headroom_db
FROM g GROUP BY path""")
def gain_stats_by_first_field(spark, sf_dir):
    return FR.gain_stats(gains(spark, sf_dir)).withColumn("avg_gain", F.round("avg_gain", 6))


@contract(f"""
WITH {GAINS}
SELECT path, min(gain) AS min_gain, max(gain) AS max_gain,
       round(pow(10e0, -((255 - max(gain)) * 1.5e0) / 20e0), 9) AS estimated_peak
FROM g GROUP BY path""")
def gain_minmax(spark, sf_dir):
    return FR.gain_minmax(gains(spark, sf_dir)).withColumn("estimated_peak", F.round("estimated_peak", 9))


@contract("""
SELECT event_id, (event_id * 7919) % 4294967296 AS be,
       CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) AS le,
       ((v >> 24) & 127) * 2097152 + ((v >> 16) & 127) * 16384 + ((v >> 8) & 127) * 128 + (v & 127) AS synchsafe
FROM (SELECT event_id, (event_id * 7919) % 4294967296 AS v, lpad(printf('%X', (event_id * 7919) % 4294967296), 8, '0') AS h FROM events)""")
def uint_from_bytes(spark, sf_dir):
    data = F.unhex(F.lpad(F.hex((F.col("event_id") * 7919) % 4294967296), 8, "0"))
    return table(spark, sf_dir, "events").select(
        "event_id", HD.uint_be(data).alias("be"), HD.uint32_le(data).alias("le"), HD.synchsafe(data).alias("synchsafe")
    )


# --- catalogs -----------------------------------------------------------------------------


@contract(f"""
WITH {PATHS}
SELECT path, length FROM f WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp3', 'm4a', 'aac', 'mp4')""")
def audio_catalog(spark, sf_dir):
    rows = CA.catalog_filter(paths(spark, sf_dir), extensions=("mp3", "m4a", "aac", "mp4"), skip_forks=False)
    return rows.select("path", "length")


@contract(f"""
WITH {PATHS}
SELECT path, length FROM f
WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp3', 'm4a', 'aac') AND path NOT LIKE '%/.\\_%' ESCAPE '\\'""")
def catalog_filter(spark, sf_dir):
    return CA.catalog_filter(paths(spark, sf_dir)).select("path", "length")


@contract("""
SELECT page_id, regexp_extract(rtrim(url, '/'), '([^/]+)$', 1) AS name FROM pages""")
def filename_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.file_name(F.col("url")).alias("name"))


@contract(f"WITH {PATHS} SELECT row_number() OVER (ORDER BY path) AS pos, path FROM f")
def sort_catalog(spark, sf_dir):
    """The position makes the order visible to a comparison that ignores row order."""
    ordered = CA.sort_catalog(paths(spark, sf_dir).select("path")).withColumn("all", F.lit(0))
    return sample_index(ordered, ["all"], ["path"], name="pos").select((F.col("pos") + 1).alias("pos"), "path")


_FOUND = """
k AS (SELECT path FROM f WHERE page_id % 3 = 0),
n AS (SELECT path FROM f UNION ALL SELECT path FROM f WHERE page_id % 5 = 0)"""


def _found(spark, sf_dir):
    rows = paths(spark, sf_dir)
    known = rows.where("page_id % 3 = 0").select("path")
    return CA.union_paths(rows.select("path"), rows.where("page_id % 5 = 0").select("path")), known


@contract(f"WITH {PATHS}, {_FOUND} SELECT path, count(*) AS times FROM n GROUP BY path")
def union_paths(spark, sf_dir):
    found, _ = _found(spark, sf_dir)
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("times"))


@contract(f"WITH {PATHS}, {_FOUND} SELECT DISTINCT path FROM n WHERE path NOT IN (SELECT path FROM k)")
def new_files_only(spark, sf_dir):
    return CA.new_files_only(*_found(spark, sf_dir))


@contract(f"""
WITH {PATHS}, {_FOUND},
a AS (SELECT count(DISTINCT path) AS added FROM n WHERE path NOT IN (SELECT path FROM k))
SELECT added, (SELECT count(*) FROM n) - added AS skipped FROM a""")
def new_files_summary(spark, sf_dir):
    return CA.new_files_summary(*_found(spark, sf_dir))


@contract(f"WITH {PATHS} SELECT page_id, path FROM f WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def select_rows(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return CA.select_rows(paths(spark, sf_dir), chosen, ["page_id"]).select("page_id", "path")


@contract(f"WITH {PATHS} SELECT page_id, path FROM f WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def drop_rows(spark, sf_dir):
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return CA.drop_rows(paths(spark, sf_dir), chosen, ["page_id"]).select("page_id", "path")


# --- files --------------------------------------------------------------------------------


def _zeros(n: int) -> Column:
    return F.lit(bytes(n))


def _text(value: str) -> Column:
    return F.lit(value.encode())


def _be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))


def _le32(n: Column) -> Column:
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("bigint")), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))


def _join(*parts: Column) -> Column:
    """Bytes end to end; NULL parts are left out."""
    return F.concat(*[F.coalesce(p, F.lit(b"")) for p in parts])


@contract("""
SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 4 = 2 AND page_id % 3 <> 0 THEN 'mp4' ELSE 'mp3' END AS kind FROM pages""")
def sniff_kind(spark, sf_dir):
    """Pages behind a file-type box: known brands, an unknown brand, a box that is too small."""
    brands = F.array(F.lit("M4A "), F.lit("isom"), F.lit("mp42"), F.lit("iso2"))
    i = F.col("page_id")
    brand = F.when((i % 4 == 2) & (i % 3 == 0), F.lit("qt  ")).otherwise(F.element_at(brands, (i % 4 + 1).cast("int")))
    size = F.when(i % 4 == 3, F.lit(11)).otherwise(F.lit(20))
    box = _join(_be32(size), _text("ftyp"), F.encode(brand, "UTF-8"))
    body = F.encode("html", "UTF-8")
    content = F.when(i % 4 == 1, body).otherwise(F.concat(box, body))
    return table(spark, sf_dir, "pages").select("page_id", HD.sniff_kind(content).alias("kind"))


def _order_files(spark, sf_dir):
    """One small file per order: optional ID3v2, junk, summary frame, 1-3 frames, trailing tags.

    Stereo frames of 96 bytes (32 kbit/s at 48 kHz) whose side information repeats one byte.
    """
    k = F.col("o_orderkey")
    header = F.lit(bytes.fromhex("FFFB1400"))
    frame = F.unhex(F.concat(F.lit("FFFB1400"), F.repeat(F.lpad(F.hex(k % 251), 2, "0"), F.lit(32)), F.lit("00" * 60)))
    ape = _join(_text("APETAGEX"), _le32(F.lit(2000)), _le32(F.lit(32)), _zeros(16))
    content = _join(
        F.when(k % 3 == 0, F.lit(b"ID3\4\0\0\0\0\1\5" + bytes(133))),
        F.when(k % 4 == 1, F.lit(bytes.fromhex("FFFB00FF1234"))),
        F.when(k % 5 == 0, _join(header, _zeros(32), _text("Xing"), _zeros(56))),
        frame,
        F.when(k % 3 >= 1, frame),
        F.when(k % 3 == 2, frame),
        F.when(k % 2 == 0, ape),
        F.when(k % 7 == 0, F.lit(b"TAG" + bytes(125))),
    )
    return spread(table(spark, sf_dir, "orders").select(k)).select(k.alias("path"), content.alias("content"))


@contract("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 251 AS b,
                  (CASE WHEN o_orderkey % 3 = 0 THEN 10 + 133 ELSE 0 END) + (CASE WHEN o_orderkey % 4 = 1 THEN 6 ELSE 0 END)
                  + (CASE WHEN o_orderkey % 5 = 0 THEN 96 ELSE 0 END) AS start,
                  unnest(range(o_orderkey % 3 + 1)) AS frame_no
           FROM orders)
SELECT CAST(k AS VARCHAR) AS path, frame_no, start + frame_no * 96 AS frame_offset, 4294644736 AS header_word,
       CAST(((b << 1) | (b >> 7)) & 255 AS INTEGER) AS g0, CAST(((b << 4) | (b >> 4)) & 255 AS INTEGER) AS g1,
       CAST(((b << 7) | (b >> 1)) & 255 AS INTEGER) AS g2, CAST(((b << 2) | (b >> 6)) & 255 AS INTEGER) AS g3
FROM o""")
def frames_job(spark, sf_dir):
    """From file contents to frames to gain values."""
    files = _order_files(spark, sf_dir).withColumn("path", F.col("path").cast("string"))
    shaped = FR.with_layout(FS.frame_rows(files))
    gain = [HD.gain_column(F.col("__v"), F.col("__m"), F.col("__x"), i).alias(f"g{i}") for i in range(4)]
    return shaped.select("path", "frame_no", "frame_offset", "header_word", *gain)


# --- gain values and plans ------------------------------------------------------------------


@contract(f"""
WITH {GAINS}, {REQUESTS}
SELECT path, frame_no, byte_offset, bit_offset, gain, least(255, greatest(0, gain + steps * 12)) AS adjusted FROM g JOIN r USING (path)""")
def adjust_saturating(spark, sf_dir):
    rows = gains(spark, sf_dir).join(gain_requests(spark, sf_dir), "path")
    out = G.adjust_saturating(F.col("gain"), F.col("steps") * 12)
    return rows.select("path", "frame_no", "byte_offset", "bit_offset", "gain", out.alias("adjusted"))


@contract(f"""
WITH {GAINS}, {REQUESTS}
SELECT path, frame_no, byte_offset, bit_offset, gain, CAST(((gain + steps * 40) % 256 + 256) % 256 AS INTEGER) AS adjusted
FROM g JOIN r USING (path)""")
def adjust_wrapping(spark, sf_dir):
    rows = gains(spark, sf_dir).join(gain_requests(spark, sf_dir), "path")
    out = G.adjust_wrapping(F.col("gain"), F.col("steps") * 40)
    return rows.select("path", "frame_no", "byte_offset", "bit_offset", "gain", out.alias("adjusted"))


@contract("""
SELECT l_orderkey, l_partkey, l_linenumber,
       concat_ws(',', q, least(255, greatest(0, q + 30)), p, least(255, greatest(0, p + 30))) AS adjusted
FROM (SELECT *, CAST(trunc(l_quantity * 5) AS INTEGER) AS q, CAST(l_partkey % 256 AS INTEGER) AS p FROM lineitem)""")
def array_channel_adjust(spark, sf_dir):
    """Granule-major arrays of two granules and two channels; only the right channel changes."""
    q, p = (F.col("l_quantity") * 5).cast("int"), (F.col("l_partkey") % 256).cast("int")
    out = G.adjust_channel(F.array(q, q, p, p), F.lit(2), 1, F.lit(30))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.concat_ws(",", out.cast("array<string>")).alias("adjusted")
    )


_LIMIT = """
i AS (SELECT event_id, CAST(event_id % 21 - 10 AS INTEGER) AS steps, CAST(event_id % 9 AS INTEGER) AS room,
             value / 333e0 AS peak, (value - 250e0) / 20e0 AS gain_db FROM events)"""


def _limit_input(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_id") % 21 - 10).cast("int").alias("steps"),
        (F.col("event_id") % 9).cast("int").alias("room"),
        (F.col("value") / 333).alias("peak"),
        ((F.col("value") - 250) / 20).alias("gain_db"),
    )


@contract(f"""
WITH {_LIMIT}
SELECT event_id, CASE WHEN steps > 0 AND steps > room THEN room ELSE steps END AS held,
       CASE WHEN steps > 0 AND steps > room THEN 'gain reduced from ' || steps || ' to ' || room || ' steps to prevent clipping' END AS held_warning,
       steps AS warned,
       CASE WHEN steps > 0 AND steps > room THEN 'clipping warning: requested ' || steps || ' steps but only ' || room || ' headroom' END AS warned_warning
FROM i""")
def limit_by_headroom(spark, sf_dir):
    held = G.limit_by_headroom(F.col("steps"), F.col("room"), prevent=True)
    warned = G.limit_by_headroom(F.col("steps"), F.col("room"))
    return _limit_input(spark, sf_dir).select(
        "event_id", held["steps"].alias("held"), held["warning"].alias("held_warning"),
        warned["steps"].alias("warned"), warned["warning"].alias("warned_warning"),
    )


@contract(f"""
WITH {_LIMIT},
c AS (SELECT *, steps > 0 AND peak * pow(10e0, steps * 1.5e0 / 20e0) > 1e0 AS over,
             steps > 0 AND peak * pow(10e0, gain_db / 20e0) > 1e0 AS over_own,
             least(steps, greatest(CAST(floor(-20e0 * log10(peak) / 1.5e0) AS INTEGER), 0)) AS safe,
             greatest(CAST(round(-20e0 * log10(peak) / 1.5e0) AS INTEGER), 0) AS near
      FROM i)
SELECT event_id, CASE WHEN over THEN safe ELSE steps END AS held,
       CASE WHEN over THEN 'gain reduced from ' || steps || ' to ' || safe || ' steps to prevent clipping (peak: ' || printf('%.4f', peak) || ')' END AS warning,
       CASE WHEN over_own THEN near ELSE steps END AS compat,
       CASE WHEN over THEN 'clipping warning: peak would be ' || printf('%.2f', peak * pow(10e0, steps * 1.5e0 / 20e0)) || ' (>1.00)' END AS only_warning
FROM c""")
def limit_by_peak(spark, sf_dir):
    args = (F.col("steps"), F.col("gain_db"), F.col("peak"))
    held = G.limit_by_peak(*args, prevent=True)
    return _limit_input(spark, sf_dir).select(
        "event_id", held["steps"].alias("held"), held["warning"].alias("warning"),
        G.limit_by_peak(*args, prevent=True, compat=True)["steps"].alias("compat"),
        G.limit_by_peak(*args)["warning"].alias("only_warning"),
    )


_PLAN = ["path", "frame_no", "gr", "ch", "byte_offset", "bit_offset", "steps", "old", "new"]
_PLAN_SQL = "path, frame_no, gr, ch, byte_offset, bit_offset, steps, gain AS old"


@contract(f"""
WITH {GAINS}, {REQUESTS}
SELECT {_PLAN_SQL}, least(255, greatest(0, gain + steps)) AS new FROM g JOIN r USING (path) WHERE steps <> 0""")
def plan_gain(spark, sf_dir):
    return GP.plan_gain(gains(spark, sf_dir), gain_requests(spark, sf_dir)).select(*_PLAN)


@contract(f"""
WITH {GAINS}, rd AS (SELECT s_suppkey AS path, CAST(round((s_acctbal / 500e0) / 1.5e0) AS INTEGER) AS steps FROM supplier)
SELECT {_PLAN_SQL}, least(255, greatest(0, gain + steps)) AS new FROM g JOIN rd USING (path) WHERE steps <> 0""")
def plan_gain_db(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_acctbal") / 500).alias("gain_db"))
    return GP.plan_gain_db(gains(spark, sf_dir), wanted).select(*_PLAN)


@contract(f"""
WITH {GAINS}, {REQUESTS}
SELECT {_PLAN_SQL}, CAST(((gain + steps) % 256 + 256) % 256 AS INTEGER) AS new FROM g JOIN r USING (path) WHERE steps <> 0""")
def plan_gain_wrap(spark, sf_dir):
    return GP.plan_gain(gains(spark, sf_dir), gain_requests(spark, sf_dir), wrap=True).select(*_PLAN)


def _modes(spark, sf_dir):
    mono = F.when(F.col("s_nationkey") == 3, "Mono").otherwise("Stereo")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), mono.alias("channel_mode"))


@contract(f"""
WITH {GAINS}, {REQUESTS}
SELECT {_PLAN_SQL}, least(255, greatest(0, gain + steps)) AS new
FROM g JOIN r USING (path) JOIN supplier ON s_suppkey = path
WHERE steps <> 0 AND ch = 1 AND s_nationkey <> 3""")
def plan_gain_channel(spark, sf_dir):
    usable, _ = GP.channel_requests(gain_requests(spark, sf_dir), _modes(spark, sf_dir))
    return GP.plan_gain(gains(spark, sf_dir), usable, channel=1).select(*_PLAN)


@contract(f"""
WITH {REQUESTS}
SELECT path, 'error' AS status, '{GP.MONO_ERROR}' AS error
FROM r JOIN supplier ON s_suppkey = path WHERE steps <> 0 AND s_nationkey = 3""")
def plan_gain_channel_errors(spark, sf_dir):
    return GP.channel_requests(gain_requests(spark, sf_dir), _modes(spark, sf_dir))[1]


@contract(f"""
WITH {GAINS}, {REQUESTS},
p AS (SELECT path, frame_no, gain <> least(255, greatest(0, gain + steps)) AS moved FROM g JOIN r USING (path) WHERE steps <> 0)
SELECT path, count(DISTINCT frame_no) AS frames, count(*) AS fields, count(*) FILTER (WHERE moved) AS changed FROM p GROUP BY path""")
def plan_summary(spark, sf_dir):
    return GP.plan_summary(GP.plan_gain(gains(spark, sf_dir), gain_requests(spark, sf_dir)), frame=["frame_no"])


@contract(f"""
WITH {GAINS}, {REQUESTS},
p AS (SELECT path, gr, ch, gain <> least(255, greatest(0, gain + steps)) AS moved FROM g JOIN r USING (path) WHERE steps <> 0)
SELECT path, count(*) FILTER (WHERE gr = 0 AND ch = 0) AS frames, count(*) AS fields, count(*) FILTER (WHERE moved) AS changed
FROM p GROUP BY path""")
def plan_summary_by_first_field(spark, sf_dir):
    return GP.plan_summary(GP.plan_gain(gains(spark, sf_dir), gain_requests(spark, sf_dir)))


@contract(f"""
WITH {GAINS}, {REQUESTS},
p AS (SELECT *, least(255, greatest(0, gain + steps)) AS after FROM g JOIN r USING (path) WHERE steps <> 0)
SELECT path, frame_no, gr, ch, byte_offset, bit_offset, -steps AS steps, after AS old, gain AS new FROM p""")
def undo_exact(spark, sf_dir):
    return GP.undo_plan(GP.plan_gain(gains(spark, sf_dir), gain_requests(spark, sf_dir))).select(*_PLAN)


@contract(f"""
WITH {GAINS}, {REQUESTS}, st AS (SELECT path, 255 - max(gain) AS room FROM g GROUP BY path)
SELECT CAST(path AS VARCHAR) AS file, 'dry_run' AS status,
       CASE WHEN steps > 0 AND steps > room THEN room ELSE steps END AS gain_applied_steps,
       (CASE WHEN steps > 0 AND steps > room THEN room ELSE steps END) * 1.5e0 AS gain_applied_db,
       CASE WHEN steps > 0 AND steps > room THEN 'gain reduced from ' || steps || ' to ' || room || ' steps to prevent clipping' END AS warning,
       TRUE AS dry_run
FROM r LEFT JOIN st USING (path)""")
def dry_run(spark, sf_dir):
    stats = FR.gain_stats(gains(spark, sf_dir))
    limited = GP.headroom_requests(gain_requests(spark, sf_dir), stats, prevent=True)
    return GP.dry_run(limited).withColumn("file", F.col("file").cast("string"))


@contract(f"""
WITH {GAINS}, st AS (SELECT path, 255 - max(gain) AS steps FROM g GROUP BY path)
SELECT {_PLAN_SQL}, least(255, greatest(0, gain + steps)) AS new FROM g JOIN st USING (path) WHERE steps > 0""")
def normalize_to_headroom(spark, sf_dir):
    fields = gains(spark, sf_dir)
    return GP.plan_gain(fields, GP.normalize_to_headroom(FR.gain_stats(fields))).select(*_PLAN)
