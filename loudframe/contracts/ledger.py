"""The ledger of applied gains and undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from loudframe.contracts.roles import GAINS, LEDGER, REQUESTS, contract, gain_requests, gains, ledger, table
from loudframe.functions import tags as T
from loudframe.operators import frames as FR
from loudframe.operators import ledger as LE
from loudframe.plans import gain_plan as GP
from loudframe.session import durable, fresh_path

_RUN = "OVER (PARTITION BY path ORDER BY ts, id)"


@contract(f"WITH {LEDGER} SELECT path, id, CAST(sum(steps) {_RUN} AS BIGINT) AS undo FROM l")
def gain_ledger(spark, sf_dir):
    return LE.gain_ledger(ledger(spark, sf_dir)).select("path", "id", "undo")


@contract(f"""
WITH {LEDGER}
SELECT path, id, CAST(sum(CASE WHEN channel IS NULL OR channel = 0 THEN steps ELSE 0 END) {_RUN} AS BIGINT) AS left_undo,
       CAST(sum(CASE WHEN channel IS NULL OR channel = 1 THEN steps ELSE 0 END) {_RUN} AS BIGINT) AS right_undo
FROM l""")
def channel_ledger(spark, sf_dir):
    return LE.channel_ledger(ledger(spark, sf_dir)).select("path", "id", "left_undo", "right_undo")


@contract(f"""
WITH {LEDGER},
a AS (SELECT *, sum(CASE WHEN channel IS NULL OR channel = 0 THEN steps ELSE 0 END) {_RUN} AS lu,
             sum(CASE WHEN channel = 1 THEN steps ELSE 0 END) {_RUN} AS ru FROM l),
c AS (SELECT *, last_value(CASE WHEN channel IS NULL THEN lu - ru END IGNORE NULLS) {_RUN} AS shift FROM a)
SELECT path, id, CAST(lu AS BIGINT) AS left_undo, CAST(ru + coalesce(shift, 0) AS BIGINT) AS right_undo FROM c""")
def channel_ledger_compat(spark, sf_dir):
    return LE.channel_ledger(ledger(spark, sf_dir), compat=True).select("path", "id", "left_undo", "right_undo")


@contract(f"""
WITH {LEDGER}
SELECT path, id, first_value(min_gain || ',' || max_gain IGNORE NULLS) {_RUN} AS minmax FROM l""")
def first_minmax(spark, sf_dir):
    return LE.first_minmax(ledger(spark, sf_dir)).select("path", "id", "minmax")


@contract(f"""
WITH {LEDGER},
x AS (SELECT path, CAST(sum(CASE WHEN channel IS NULL OR channel = 0 THEN steps ELSE 0 END) AS BIGINT) AS left_undo,
             CAST(sum(CASE WHEN channel IS NULL OR channel = 1 THEN steps ELSE 0 END) AS BIGINT) AS right_undo,
             last(wrap ORDER BY ts, id) AS wrap,
             first(min_gain || ',' || max_gain ORDER BY ts, id) FILTER (WHERE min_gain IS NOT NULL) AS minmax,
             count(*) AS entries
      FROM l GROUP BY path)
SELECT *, printf('%+04d,%+04d,', left_undo, right_undo) || CASE WHEN wrap THEN 'W' ELSE 'N' END AS undo_tag FROM x""")
def ledger_state(spark, sf_dir):
    return LE.ledger_state(ledger(spark, sf_dir))


def _entries(spark, sf_dir, record=True):
    stats = FR.gain_stats(gains(spark, sf_dir))
    ts, key = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("path")
    return GP.ledger_entries(gain_requests(spark, sf_dir), stats, ts, key, wrap=True, record=record)


_ENTRY = ["path", "id", "channel", "steps", "wrap", "min_gain", "max_gain"]


@contract(f"""
WITH {GAINS}, {REQUESTS}, st AS (SELECT path, min(gain) AS min_gain, max(gain) AS max_gain FROM g GROUP BY path)
SELECT path, path AS id, CAST(NULL AS INTEGER) AS channel, steps, TRUE AS wrap, min_gain, max_gain
FROM r LEFT JOIN st USING (path) WHERE steps <> 0""")
def ledger_append(spark, sf_dir):
    return _entries(spark, sf_dir).select(*_ENTRY)


@contract(f"""
WITH {GAINS}, {REQUESTS},
p AS (SELECT path, count(DISTINCT frame_no) AS frames FROM g JOIN r USING (path) WHERE steps <> 0 GROUP BY path)
SELECT path, frames, CAST(0 AS BIGINT) AS ledger_rows FROM p""")
def no_ledger(spark, sf_dir):
    """Applying without a record: the plan has its frames, the ledger gets no row."""
    plan = GP.plan_summary(
        GP.plan_gain(gains(spark, sf_dir), gain_requests(spark, sf_dir)), frame=["frame_no"]
    ).select("path", "frames")
    rows = _entries(spark, sf_dir, record=False).groupBy("path").agg(F.count(F.lit(1)).alias("ledger_rows"))
    return plan.join(rows, "path", "left").withColumn("ledger_rows", F.coalesce("ledger_rows", F.lit(0).cast("bigint")))


@contract(f"""
WITH {LEDGER},
x AS (SELECT path, CAST(sum(steps) AS BIGINT) AS total FROM l WHERE channel IS NULL GROUP BY path),
y AS (SELECT c_custkey AS path, x.path IS NOT NULL AS has_tag,
             CASE WHEN x.path IS NOT NULL AND c_custkey % 4 <> 1 THEN CAST(total AS INTEGER) END AS undo
      FROM customer LEFT JOIN x ON x.path = c_custkey)
SELECT path, CASE WHEN NOT has_tag OR undo IS NULL THEN 'error' WHEN undo = 0 THEN 'skipped' ELSE 'success' END AS status,
       -undo AS steps,
       CASE WHEN NOT has_tag THEN 'No APE tag found - cannot undo' WHEN undo IS NULL THEN 'No MP3GAIN_UNDO tag found - cannot undo' END AS error
FROM y""")
def undo(spark, sf_dir):
    """Undo by the stored tag text: some files have no tag, some tags cannot be read."""
    both = LE.ledger_state(ledger(spark, sf_dir).where(F.col("channel").isNull()))
    text = F.when(F.col("path") % 4 == 1, F.lit("x,+003,N")).otherwise(F.col("undo_tag"))
    parsed = both.select("path", F.lit(True).alias("has_tag"), T.undo_steps(text).alias("undo"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return GP.undo_requests(files, parsed).select("path", "status", "steps", "error")


# --- undo as an event: every eleventh entry takes back what came before ------------------------

_EVENTS = LEDGER + """,
ev AS (SELECT *, id % 11 = 0 AS undone FROM l),
ep AS (SELECT *, CAST(sum(CASE WHEN undone THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, id) AS BIGINT) AS epoch FROM ev)"""


def _events(spark, sf_dir):
    return ledger(spark, sf_dir).withColumn("event", F.when(F.col("id") % 11 == 0, LE.UNDO).otherwise("apply"))


_IN_EPOCH = "OVER (PARTITION BY path, epoch ORDER BY ts, id)"


@contract(f"""
WITH {_EVENTS}
SELECT path, id, epoch, CAST(sum(CASE WHEN NOT undone AND (channel IS NULL OR channel = 0) THEN steps ELSE 0 END) {_IN_EPOCH} AS BIGINT) AS left_undo,
       CAST(sum(CASE WHEN NOT undone AND (channel IS NULL OR channel = 1) THEN steps ELSE 0 END) {_IN_EPOCH} AS BIGINT) AS right_undo,
       first_value(CASE WHEN NOT undone THEN min_gain || ',' || max_gain END IGNORE NULLS) {_IN_EPOCH} AS minmax
FROM ep""")
def epoch_ledger(spark, sf_dir):
    """Undo values and gain range restart after each undo."""
    return LE.epoch_ledger(_events(spark, sf_dir)).select("path", "id", "epoch", "left_undo", "right_undo", "minmax")


@contract(f"""
WITH {_EVENTS}, {GAINS},
cu AS (SELECT path, CAST(sum(CASE WHEN channel IS NULL OR channel = 0 THEN steps ELSE 0 END) AS BIGINT) AS undo FROM ep AS e
       WHERE NOT undone AND epoch = (SELECT max(epoch) FROM ep WHERE ep.path = e.path) GROUP BY path),
st AS (SELECT path, count(DISTINCT frame_no) AS frames FROM g GROUP BY path),
x AS (SELECT c_custkey AS path, undo, frames, CASE WHEN undo IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN 'No MP3GAIN_UNDO tag found - cannot undo'
                                                              ELSE 'No APE tag found - cannot undo' END
             WHEN undo <> 0 AND frames IS NULL THEN 'No valid MP3 frames found' END AS error
      FROM customer LEFT JOIN cu ON cu.path = c_custkey LEFT JOIN st ON st.path = c_custkey)
SELECT path AS file, CASE WHEN error IS NOT NULL THEN 'error' WHEN undo = 0 THEN 'skipped' ELSE 'success' END AS status,
       CASE WHEN error IS NULL THEN CASE WHEN undo = 0 THEN 0 ELSE frames END END AS frames, error
FROM x""")
def undo_run(spark, sf_dir):
    """Undo by the ledger since each file's last undo, with the frames that are restored."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    stats = FR.gain_stats(gains(spark, sf_dir), frame=["frame_no"])
    report, _, _ = GP.undo_run(customers, _events(spark, sf_dir), stats, F.current_timestamp(), F.col("path"), tagged=customers.where("path % 2 = 0"))
    return report.select("file", "status", "frames", "error")


@contract(f"""
WITH {GAINS}, {REQUESTS},
s AS (SELECT path, steps AS s1, CAST(path % 5 + 1 AS INTEGER) AS s2 FROM r),
c AS (SELECT g.*, s1, s2, greatest(0, least(255, greatest(0, least(255, gain + s1)) - s1)) AS back FROM g JOIN s USING (path)),
e AS (SELECT *, greatest(0, least(255, back + s2)) AS done FROM c)
SELECT path, CAST(sum(back) AS BIGINT) AS restored, CAST(sum(done) AS BIGINT) AS total, printf('%+04d,%+04d,N', any_value(s2), any_value(s2)) AS undo_tag,
       min(back) || ',' || max(back) AS minmax, CAST(CASE WHEN any_value(s1) = 0 THEN 1 ELSE 3 END AS BIGINT) AS ledger_rows
FROM e GROUP BY path""")
def undo_cycle(spark, sf_dir):
    """Apply, undo, apply other steps: gains, and the ledger that is appended to (each batch twice) and read on the way."""
    fields, first = gains(spark, sf_dir), gain_requests(spark, sf_dir)
    target = fresh_path(spark, "undo-cycle")
    second = first.select("path", (F.col("path") % 5 + 1).cast("int").alias("steps"))

    def apply(now, requests, batch):
        stats = FR.gain_stats(now, frame=["frame_no"])
        ts = F.timestamp_seconds(F.lit(batch))
        entries = GP.ledger_entries(requests, stats, ts, F.col("path")).join(stats.select("path"), "path").withColumn("event", F.lit("apply"))
        for _ in range(2):
            GP.append_ledger(entries, target, batch)
        return GP.apply_requests(now, requests)

    applied = durable(apply(fields, first, 0))
    stats = FR.gain_stats(applied, frame=["frame_no"])
    files = first.select("path")
    _, requests, entries = GP.undo_run(files, GP.read_ledger(spark, target), stats, F.timestamp_seconds(F.lit(1)), F.col("path"))
    for _ in range(2):
        GP.append_ledger(entries, target, 1)
    back = durable(GP.apply_requests(applied, requests))
    after = durable(apply(back, second, 2))
    rows = GP.read_ledger(spark, target)
    state = LE.ledger_state(LE.current_entries(rows)).select("path", "undo_tag", "minmax")
    return (after.groupBy("path").agg(F.sum("gain").cast("bigint").alias("total"))
            .join(back.groupBy("path").agg(F.sum("gain").cast("bigint").alias("restored")), "path")
            .join(state, "path").join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("ledger_rows")), "path"))
