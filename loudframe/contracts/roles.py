"""How the shared tables play the library's roles, as DataFrames and as SQL.

samples: events (track = user_id, album = user_id % 10, sample = value in cents, 5 samples per
window); packets: embeddings (track = label, packet_no = vec_id); gains: lineitem (path =
l_suppkey); ledger: orders (path = o_custkey); tags: documents; paths: pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe.functions.tags import format_gain_tag
from loudframe.operators.ordered import sample_index, time_blocks
from loudframe.operators.windows import window_sums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PER_WINDOW = 5
ROWS_PER_TASK = 2_000
KEYS = ["album", "track"]


def contract(sql: str | None = None):
    """Register a query under its function name, with its SQL statement if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: Column) -> DataFrame:
    """Rows dealt over the cluster, before they grow into whole file contents; rows with equal ``by`` to one task.

    A directory of real files is split by size when it is listed; a small table is one split. Tasks
    grow in number with the table, not in rows.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks, *by)


def directory(doc_id: Column) -> Column:
    """The directory of a document's file: a thousand documents each."""
    return F.floor(doc_id / 1000).cast("string")


# --- samples ------------------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("album"),
        F.col("user_id").alias("track"),
        "ts",
        "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("v"),
    )


def indexed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_index(samples(spark, sf_dir), KEYS, ["ts", "event_id"], time_blocks("ts", 6 * 3600))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_sums(indexed_samples(spark, sf_dir), KEYS, F.col("n"), PER_WINDOW, F.col("v"))


SAMPLES = """
s AS (SELECT user_id % 10 AS album, user_id AS track, ts, event_id,
             CAST(round(value * 100) AS BIGINT) AS v,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n
      FROM events)"""

WINDOWS = SAMPLES + """,
w AS (SELECT album, track, n // 5 AS window_no, CAST(sum(2 * v * v) AS BIGINT) AS sum_squares,
             count(*) AS samples, max(abs(v)) AS peak
      FROM s GROUP BY ALL),
b AS (SELECT *, CAST(trunc(1000e0 * log10(sum_squares::DOUBLE / samples::DOUBLE * 0.5e0 + 1e-37)) AS INTEGER) + 2000 AS raw
      FROM w)"""

HISTOGRAM = WINDOWS + """,
h AS (SELECT album, track, CAST(raw AS INTEGER) AS bin, count(*) AS cnt, max(peak) AS peak
      FROM b WHERE raw >= 0 AND raw < 12000 GROUP BY ALL)"""


def level_sql(source: str, keys: str, name: str) -> str:
    """CTEs that turn histogram rows (keys, bin, cnt, peak) into loudness rows."""
    part = f"PARTITION BY {keys}" if keys else ""
    key_list = f"{keys}, " if keys else ""
    return f"""
{name}_c AS (SELECT {key_list}bin, cnt, peak, sum(cnt) OVER ({part} ORDER BY bin DESC) AS cum, sum(cnt) OVER ({part}) AS total
             FROM {source}),
{name} AS (SELECT {key_list}CAST(max(total) AS BIGINT) AS windows, max(peak) AS peak,
                  (max(CASE WHEN cum >= ceil(total::DOUBLE * (1e0 - 0.95e0)) THEN bin END) - 2000) / 100e0 AS loudness_db
           FROM {name}_c GROUP BY ALL)"""


TRACKS = HISTOGRAM + "," + level_sql("h", "album, track", "t")
ALBUM_HIST = """
ah AS (SELECT album, bin, CAST(sum(cnt) AS BIGINT) AS cnt, max(peak) AS peak FROM h GROUP BY ALL)"""
ALBUMS = TRACKS + "," + ALBUM_HIST + "," + level_sql("ah", "album", "a")
STEPS = "CAST(round((64.82e0 - {0}) / 1.5e0) AS INTEGER)"

# --- packets ------------------------------------------------------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit(0).alias("album"),
        F.col("label").alias("track"),
        F.col("vec_id").alias("packet_no"),
        F.lit(44100).alias("sample_rate"),
        F.lit("F32").alias("format"),
        F.col("embedding").cast("array<double>").alias("left"),
        F.lit(None).cast("array<double>").alias("right"),
    )


# --- gains, header words --------------------------------------------------------------


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lines can share (order, line number), so that pair is a frame with many fields."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("path"),
        F.col("l_orderkey").alias("frame_no"),
        (F.col("l_linenumber") % 2).alias("gr"),
        (F.col("l_partkey") % 2).cast("int").alias("ch"),
        F.col("l_partkey").alias("byte_offset"),
        (F.col("l_linenumber") % 8).alias("bit_offset"),
        (F.col("l_quantity") * 5).cast("int").alias("gain"),
    )


GAINS = """
g AS (SELECT l_suppkey AS path, l_orderkey AS frame_no, l_linenumber % 2 AS gr, CAST(l_partkey % 2 AS INTEGER) AS ch,
             l_partkey AS byte_offset, l_linenumber % 8 AS bit_offset, CAST(trunc(l_quantity * 5) AS INTEGER) AS gain
      FROM lineitem)"""


def gain_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier: -8 to +8 steps."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("path"), (F.col("s_suppkey") % 17 - 8).cast("int").alias("steps")
    )


REQUESTS = "r AS (SELECT s_suppkey AS path, CAST(s_suppkey % 17 - 8 AS INTEGER) AS steps FROM supplier)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header words from a mixed counter, side information from digests."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"),
        F.col("event_id").alias("frame_no"),
        F.col("event_id").alias("frame_offset"),
        (F.lit(0xFFE00000) + (F.col("event_id") * F.lit(2654435761)).bitwiseAND(F.lit(0x1FFFFF))).alias("header_word"),
        F.unhex(F.concat(F.md5(F.col("event_id").cast("string").cast("binary")),
                         F.md5((F.col("event_id") + 1).cast("string").cast("binary")))).alias("side_info"),
    )


FRAMES = """
f AS (SELECT user_id AS path, event_id AS frame_no, event_id AS frame_offset,
             4292870144 + ((event_id * 2654435761) & 2097151) AS w,
             CAST(unhex(md5(event_id::VARCHAR) || md5((event_id + 1)::VARCHAR)) AS BIT)::VARCHAR AS bits
      FROM events),
d AS (SELECT *, CASE (w >> 19) & 3 WHEN 3 THEN 'MPEG1' WHEN 2 THEN 'MPEG2' WHEN 0 THEN 'MPEG2.5' END AS mpeg_version,
             CASE WHEN (w >> 17) & 3 > 0 THEN CAST(4 - ((w >> 17) & 3) AS INTEGER) END AS layer,
             (w >> 16) & 1 = 0 AS has_crc,
             CAST((w >> 12) & 15 AS INTEGER) AS bi, CAST((w >> 10) & 3 AS INTEGER) AS si,
             (w >> 9) & 1 = 1 AS padding,
             ['Stereo', 'Joint Stereo', 'Dual Channel', 'Mono'][CAST((w >> 6) & 3 AS INTEGER) + 1] AS channel_mode
      FROM f),
e AS (SELECT *,
             CASE WHEN mpeg_version = 'MPEG1'
                  THEN [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][bi + 1]
                  ELSE [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160][bi + 1] END AS bitrate_kbps,
             CASE mpeg_version WHEN 'MPEG1' THEN [44100, 48000, 32000][si + 1]
                               WHEN 'MPEG2' THEN [22050, 24000, 16000][si + 1]
                               WHEN 'MPEG2.5' THEN [11025, 12000, 8000][si + 1] END AS sample_rate
      FROM d),
k AS (SELECT *, CAST((CASE WHEN mpeg_version = 'MPEG1' THEN 1152 ELSE 576 END) * bitrate_kbps * 125 // sample_rate
                     + CASE WHEN padding THEN 1 ELSE 0 END AS INTEGER) AS frame_size,
             (w >> 21) = 2047 AND mpeg_version IS NOT NULL AND (w >> 17) & 3 = 1 AND bi NOT IN (0, 15) AND si <> 3 AS valid
      FROM e)"""

FRAME_GAINS = FRAMES + """,
p AS (SELECT k.*, CAST(i // nch AS INTEGER) AS gr, CAST(i % nch AS INTEGER) AS ch,
             CASE WHEN mpeg_version = 'MPEG1' THEN (CASE WHEN nch = 1 THEN 18 ELSE 20 END) + i * 59 + 21
                  ELSE (CASE WHEN nch = 1 THEN 9 ELSE 10 END) + i * 63 + 21 END AS bit
      FROM (SELECT *, CASE WHEN channel_mode = 'Mono' THEN 1 ELSE 2 END AS nch FROM k WHERE valid) AS k,
           (SELECT unnest(range(4)) AS i) AS n
      WHERE i < nch * (CASE WHEN mpeg_version = 'MPEG1' THEN 2 ELSE 1 END)),
q AS (SELECT *, CAST(frame_offset + (CASE WHEN has_crc THEN 6 ELSE 4 END) + bit // 8 AS BIGINT) AS byte_offset,
             CAST(bit % 8 AS INTEGER) AS bit_offset,
             CAST(('0b' || substr(bits, CAST(bit + 1 AS INTEGER), 8)) AS INTEGER) AS gain
      FROM p)"""

# --- ledger ---------------------------------------------------------------------------


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third entry concerns both channels; some entries carry no gain range."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("path"),
        F.col("o_orderdate").alias("ts"),
        key.alias("id"),
        F.when(key % 3 != 0, (key % 2).cast("int")).alias("channel"),
        (key % 13 - 6).cast("int").alias("steps"),
        (key % 4 == 0).alias("wrap"),
        F.when(key % 5 < 3, (key % 100).cast("int")).alias("min_gain"),
        F.when(key % 5 < 3, (key % 100 + 100).cast("int")).alias("max_gain"),
    )


LEDGER = """
l AS (SELECT o_custkey AS path, o_orderdate AS ts, o_orderkey AS id,
             CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 AS INTEGER) END AS channel,
             CAST(o_orderkey % 13 - 6 AS INTEGER) AS steps, o_orderkey % 4 = 0 AS wrap,
             CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 100 AS INTEGER) END AS min_gain,
             CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 100 + 100 AS INTEGER) END AS max_gain
      FROM orders)"""

# --- tags, paths, reports -----------------------------------------------------------------


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tag rows per document, in one of three namespaces; French documents have none. Keys differ in case."""
    docs = table(spark, sf_dir, "documents").where("lang <> 'fr'")
    docs = docs.withColumn("gain", format_gain_tag(F.col("n_chars") % 3000 / 128))
    return docs.selectExpr(
        "doc_id AS path",
        """stack(4, 0, 'Replaygain_Track_Gain', gain,
                    1, 'MP3GAIN_UNDO', format_string('%+04d,%+04d,N', doc_id % 9 - 4, doc_id % 7 - 3),
                    2, 'Language', lang,
                    3, 'LANGUAGE', source) AS (pos, key, value)""",
    ).selectExpr("path", "element_at(array('APEv2', 'com.apple.iTunes', 'com.x'), int(path % 3 + 1)) AS namespace", "pos", "key", "value")


TAGS = """
t4 AS (SELECT doc_id AS path, ['APEv2', 'com.apple.iTunes', 'com.x'][doc_id % 3 + 1] AS namespace, u.pos AS pos, u.key AS key, u.value AS value
       FROM documents, LATERAL (VALUES
         (0, 'Replaygain_Track_Gain', printf('%+.2f dB', (n_chars % 3000) / 128e0)),
         (1, 'MP3GAIN_UNDO', printf('%+04d,%+04d,N', doc_id % 9 - 4, doc_id % 7 - 3)),
         (2, 'Language', lang),
         (3, 'LANGUAGE', source)) AS u(pos, key, value)
       WHERE lang <> 'fr')"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths below the page addresses, with mixed extensions and some resource forks."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """concat(url, CASE WHEN page_id % 7 = 0 THEN '/._take' ELSE '/take' END,
                  element_at(array('.mp3', '.M4A', '.txt', '.aac', '.Mp4', '.ogg', ''), int(page_id % 7 + 1))) AS path""",
        "CAST(length(html) AS BIGINT) AS length",
    )


PATHS = """
f AS (SELECT page_id, url || CASE WHEN page_id % 7 = 0 THEN '/._take' ELSE '/take' END
             || ['.mp3', '.M4A', '.txt', '.aac', '.Mp4', '.ogg', ''][page_id % 7 + 1] AS path,
             length(html) AS length
      FROM pages)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: documents with their labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")
