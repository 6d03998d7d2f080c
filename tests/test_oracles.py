"""Every registered query runs; those with an oracle equal DuckDB on the same tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"
ORDERED = [  # operators built on the running values, checked again with every group treated as hot
    "run_report", "cell_stats", "nearest_rank_linear", "paired_by_position", "ema_profile", "flow_contention", "size_cap",
    "size_shards", "warm_window", "counter_deltas", "shard_offsets", "traffic_report", "classify_puts", "lane_count",
    "number_runs", "sort_runs", "stream_phase_changes", "frame_index", "gc_runs", "paired_bootstrap", "global_tracks"]


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, FOLDER, sql, tolerance=1e-5) == ""


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_hot_groups(hot, name):
    df = entry.queries()[name](hot, FOLDER)
    assert compare(df, FOLDER, entry.oracle_sql()[name], tolerance=1e-5) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
