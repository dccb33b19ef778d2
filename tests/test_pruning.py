"""Registered queries with bounds read only what their bounds let through."""

import pytest
from helpers import plan_text

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
BOUNDED = (
    "read_recent", "page_after_cursor", "filter_range_union", "aggregate_with_rollup", "aggregate_with_rollup_filtered",
    "aggregate_route_falls_back", "aggregate_with_tiers", "evict_rollup", "dashboard_report", "dashboard_from_tiers", "retention_expired",
    "retention_survivors",
)


@pytest.mark.parametrize("name", BOUNDED)
def test_bounds_reach_the_scan(spark, name):
    scans = [line for line in plan_text(contract.queries()[name](spark, SF)).splitlines() if "PushedFilters:" in line]
    assert scans and all("(ts," in line for line in scans)
