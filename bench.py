"""Seconds per headline query: one warm-up run, then the median of three, full result to a no-op sink.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from loudframe.contracts import QUERIES
from loudframe.session import local_session

HEADLINE = (
    "track_loudness", "album_loudness", "loudness_rollup", "loudness_table", "loudest_windows", "equal_loudness_filter",
    "filtered_track_loudness", "frames_job", "frame_stats", "gain_stats", "plan_gain", "plan_summary", "gain_ledger",
    "channel_ledger", "ledger_state", "tag_columns", "merge_tag_rows", "ape_tags_job", "mp4_tags_job", "track_gain_report",
    "batch_summary",
)


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("bench", cpus=cpus, memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(3)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
