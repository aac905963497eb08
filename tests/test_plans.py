"""What the physical plans must and must not hold."""

import pytest

from wayfare.operators.cleaning import clean_trips
from wayfare.plans import profit, routes, trips as trip_plans
from wayfare.queries import QUERIES
from wayfare.session import scratch_path
from wayfare.sources import derived, files

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"]
PLANNED = [
    "taxi_utilization", "driver_utilization", "next_fare_by_borough", "borough_idle",
    "cross_borough", "trip_boroughs_by_shuffle", "peak_window_routes", "recent_routes",
    "ranked_top_windows", "latest_window_routes", "rolling_routes", "rolling_changes",
    "minute_ticks", "profit_by_cell", "exact_profit_by_cell", "empty_taxis",
    "profitable_areas_wide", "profitability_by_window", "degree_centrality", "wedge_count",
    "triangles_total", "pagerank", "missing_profile", "missing_by_class", "missing_corr",
    "imputation_report", "class_report", "roc_area", "feature_rank", "sql_borough_function",
    "utilization_summary", "graph_stats", "hubs",
]


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    for key in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields"):
        spark.conf.set(key, 100_000)
    yield
    for key in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields"):
        spark.conf.unset(key)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairs_and_no_python(spark, tiny, name):
    plan = plan_of(QUERIES[name](spark, tiny))
    assert not [node for node in FORBIDDEN if node in plan]


@pytest.fixture(scope="module")
def stored(spark, tiny):
    path = scratch_path(spark, "trips")
    files.write_table(derived.trips(spark, tiny), path)
    return files.read_table(spark, path)


def scans(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line]


def read_columns(scan: str) -> set[str]:
    fields = scan.split("ReadSchema: struct<")[1].rsplit(">", 1)[0]
    return {f.split(":")[0] for f in fields.split(",")}


def test_cleaning_reaches_the_scan(stored):
    scan = scans(plan_of(clean_trips(stored).select("trip_id")))[0]
    assert "PushedFilters: [" in scan and "IsNotNull(medallion)" in scan
    assert "GreaterThan(trip_distance,0.0)" in scan


def test_only_needed_columns_are_read(stored):
    needed = {"medallion", "pickup_unix", "dropoff_unix", "trip_id"}
    for scan in scans(plan_of(trip_plans.taxi_utilization(stored))):
        assert read_columns(scan) <= needed
    plan = plan_of(profit.empty_taxis(profit.with_end_cells(stored)))
    assert all("fare_amount" not in read_columns(scan) for scan in scans(plan))


def test_sampling_pass_moves_only_the_sample(stored):
    """Keys are not counted: what is shuffled for the borders is filtered to the sample first."""
    plan = plan_of(trip_plans.with_idle_time(stored))
    assert "xxhash64(medallion" in plan and "partial_collect_list" in plan
    needed = {"medallion", "pickup_unix", "dropoff_unix", "trip_id"}
    scan = scans(plan_of(trip_plans.taxi_utilization(stored)))
    assert all(read_columns(s) <= needed for s in scan)


def test_top_k_is_trimmed_before_the_shuffle(stored):
    plan = plan_of(routes.rolling_routes(stored))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(routes.recent_routes(stored))


def test_one_shuffle_of_trips_for_utilization(stored):
    """Trips move once, by taxi and slice; what else moves is aggregated."""
    lines = plan_of(trip_plans.with_idle_time(stored)).splitlines()
    shuffles = [line for line in lines if "Exchange hashpartitioning" in line]
    assert len([s for s in shuffles if "medallion" in s and "__slice" in s]) <= 2


def test_empty_taxis_merge_before_the_shuffle(stored):
    plan = plan_of(profit.empty_taxis(profit.with_end_cells(stored)))
    assert "Window" not in plan and plan.count("partial_max") == 1
