"""The shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.functions.time import DAY
from airmetrics.operators.flatlines import flatline_counts
from airmetrics.operators.gaps import reading_gaps
from airmetrics.operators.impute import drop_missing, forward_fill, interpolate
from airmetrics.operators.metrics import device_metrics
from airmetrics.operators.series import Layout
from airmetrics.operators.trends import daily_health
from airmetrics.plans.stations import run_pipeline
from airmetrics.sources.folders import shared_folder
from airmetrics.sources.readings import read_readings
from airmetrics.sources.snapshots import read_snapshots, write_snapshots
from tests.conftest import SENSORS
from tests.test_series import skewed_rows


@pytest.fixture(scope="module")
def stored(spark, contract):
    """Readings in Parquet, so that scans show what is pushed down."""
    path = shared_folder(spark, "plans")
    sensors = ", ".join(f"double(id % {7 + i}) as {s}" for i, s in enumerate(SENSORS))
    spark.range(5000).selectExpr(
        "string(id) as event_id",
        "timestamp_seconds(1704067200 + id * 60) as timestamp",
        "concat('s', id % 3) as station_id",
        "concat('d', id % 4) as device_id",
        *sensors.split(", "),
    ).write.parquet(path)
    return read_readings(spark, path, contract)


@pytest.fixture
def plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(text):
    """Keys of the shuffles that run; reused ones are not run again."""
    lines = [line for line in text.splitlines() if "ReusedExchange" not in line]
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", "\n".join(lines))
    return [re.sub(r"#\d+L?", "", e).rsplit(", ", 1)[0] for e in found]


def no_python(text):
    return not re.search(r"Python|ArrowEval|Pandas", text)


def test_whole_series_run_shuffles_rows_once(stored, contract, plan):
    text = plan(run_pipeline(stored, contract, PipelineConfig(chunk=None)).devices)
    assert exchanges(text) == ["station_id, device_id"]
    assert no_python(text) and "CartesianProduct" not in text and "NestedLoop" not in text


def test_sliced_run_shuffles_rows_once(stored, contract, plan):
    """Three readers of the raw rows, one shuffle of them; only small frames move besides."""
    text = plan(run_pipeline(stored, contract, PipelineConfig(chunk="1d")).results)
    rows = [e for e in exchanges(text) if e == "station_id, device_id, _slice"]
    # One for the raw rows, one for the carried edges (one row per slice).
    assert len(rows) == 2
    assert text.count("ReusedExchange") >= 2
    assert no_python(text) and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("renamed", [False, True])
def test_sliced_operators_reuse_their_shuffle(stored, contract, plan, renamed):
    day = Layout(slice_us=DAY)
    rows = stored.withColumn("timestamp", F.col("timestamp")) if renamed else stored
    for df in (
        interpolate(rows, SENSORS, day),
        forward_fill(rows, SENSORS, day),
        device_metrics(rows, layout=day),
        daily_health(rows, contract, layout=day),
        reading_gaps(rows, layout=day),
    ):
        text = plan(df)
        spread = [line for line in text.splitlines() if "REPARTITION_BY_COL" in line]
        assert len(spread) >= 2 and sum("ReusedExchange" not in line for line in spread) == 1
        assert "SortAggregate" not in text


def test_running_frames_only(stored, plan):
    """Frames that reach to the end of a partition are quadratic in Spark."""
    for df in (interpolate(stored, SENSORS), interpolate(stored, SENSORS, Layout(slice_us=DAY))):
        assert "unboundedfollowing" not in plan(df)


def test_flatlines_leave_the_slice_as_few_rows(stored, contract, plan):
    text = plan(flatline_counts(stored, contract, Layout(slice_us=DAY)))
    assert exchanges(text) == [
        "station_id",
        "station_id, device_id, sensor",
        "station_id, device_id, _slice",
    ]


def test_station_filter_and_columns_reach_the_scan(spark, stored, contract, plan):
    rows = read_readings(spark, stored, contract, stations="s1", start="2024-01-01T06:00:00Z")
    text = plan(interpolate(rows, ["discharge_pressure"]).select("station_id", "discharge_pressure"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    pushed, schema = scan.split("PushedFilters: ")[1].split("ReadSchema: ")
    assert "EqualTo(station_id,s1)" in pushed and "GreaterThanOrEqual(timestamp" in pushed
    assert "discharge_pressure" in schema and "motor_speed" not in schema


def test_station_filter_passes_the_windows(stored, plan):
    text = plan(interpolate(stored, SENSORS).filter("station_id = 's1'"))
    assert "EqualTo(station_id,s1)" in text


def test_drop_needs_no_shuffle(stored, plan):
    assert exchanges(plan(drop_missing(stored, SENSORS))) == []


def test_snapshot_reads_are_pruned(spark, frame, contract, plan):
    path = shared_folder(spark, "snap")
    write_snapshots(run_pipeline(frame(skewed_rows(1, 50)), contract).results, path)
    text = plan(read_snapshots(spark, path, "s1", end="2024-01-05T00:00:00Z"))
    assert "EqualTo(station_id,s1)" in text and "PartitionFilters: [(" in text


def test_carried_edges_follow_the_measured_size(spark, stored):
    """No forced broadcast: with adaptive planning small edges are broadcast, large ones are not."""
    df = interpolate(stored, SENSORS, Layout(slice_us=DAY))
    logical = df._jdf.queryExecution().analyzed().toString()
    assert "hint" not in logical.lower()
    assert df.agg(F.count(F.lit(1))).first()[0] == 5000
