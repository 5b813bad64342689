"""What the physical plans may and may not contain."""

import re
from pathlib import Path

import pytest

from loudframe.contracts import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="shared tables not present")
BATCH = [n for n in QUERIES if not n.startswith(("stream_", "incremental_"))]


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit"):
        assert bad not in text


def read_columns(text):
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<(.*)>", text)]


def test_scans_read_only_what_is_needed(spark):
    assert read_columns(plan(spark, "ledger_state")) == [{"o_custkey", "o_orderdate", "o_orderkey"}]
    assert read_columns(plan(spark, "gain_minmax")) == [{"l_suppkey", "l_quantity"}]
    for columns in read_columns(plan(spark, "track_loudness")):
        assert columns <= {"event_id", "ts", "user_id", "value"}
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan(spark, "delete_tags")


def test_scalar_queries_need_no_shuffle(spark):
    for name in ("decode_header", "frame_size", "read_gain", "limit_by_peak", "tag_set", "format_undo", "normalize_samples"):
        assert "Exchange" not in plan(spark, name)


def test_aggregations_shrink_before_they_shuffle(spark):
    for name in ("gain_minmax", "gain_stats_by_first_field", "frame_stats", "ledger_state", "peak", "tag_columns"):
        text = plan(spark, name)
        assert "partial_" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1
