"""Registered queries against their SQL twin. WASTELAKE_ALL=1 runs every query, else a cross-section."""

import os

import pytest

from tests.compare import compare, duck
from wastelake.catalog import load

SF = os.environ.get("WASTELAKE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = load()
SAMPLE = [
    "filter_scope", "project_density_band", "site_identity", "resolve_conflicts", "exclusion_reasons", "join_null_safe", "bin_day_grid", "detect_cycle",
    "holidays_since_success", "attempt_chain_status", "next_day_features", "cumulative_cutoffs", "polygon_checks", "point_in_polygon", "nearest_point",
    "path_position", "resident_factor", "classify_area", "service_summary", "request_trend", "activity_ranking", "population_summary", "site_page",
    "collection_stops", "plan_figures", "stratified_min_hash", "group_metrics", "quantile_knots", "scan_csv_null_token", "parse_history_json",
    "replace_partition", "merge_changed_revision", "stream_trend",
]
NAMES = sorted(TWINS) if os.environ.get("WASTELAKE_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    diff = compare(spark, duck(SF), SF, QUERIES[name], TWINS[name])
    assert diff in (None, "both empty"), diff


def test_every_twin_belongs_to_a_query():
    assert set(TWINS) <= set(QUERIES)
