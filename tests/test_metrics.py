"""Metrics, quality and whole runs on hand-made data."""

import pytest
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.functions.time import DAY, HOUR
from airmetrics.operators.faults import power_without_flow, sustained_zero_flow
from airmetrics.operators.metrics import METRICS, device_metrics, metrics_long
from airmetrics.operators.quality import missing_by_device, outside_typical, range_counts, score
from airmetrics.operators.ranges import null_out_of_range
from airmetrics.operators.resample import fill_grid, resample
from airmetrics.operators.series import Layout
from airmetrics.operators.stations import busiest_readings, busiest_slice, check_device_counts
from airmetrics.operators.trends import daily_health, pressure_trend
from airmetrics.plans.stations import run_pipeline
from tests.conftest import SENSORS, T0
from tests.test_series import skewed_rows

PRESSURE = "discharge_pressure"


@pytest.mark.parametrize("layout", [Layout(), Layout(slice_us=HOUR), Layout(slice_us=DAY)])
def test_unit_metrics(unit_frame, layout):
    m, quiet = device_metrics(unit_frame, layout=layout).orderBy("device_id").collect()
    assert (m.uptime_seconds, m.cycle_count, m.reading_count) == (4800, 2, 6)
    assert m.total_flow_volume_m3 == pytest.approx(60)
    assert m.average_pressure_bar == pytest.approx(8) and m.peak_pressure_bar == 10
    assert m.specific_power_kw_per_m3h == pytest.approx(5 / 12)
    assert m.thermal_efficiency_temp_per_kw == pytest.approx(58 / 26)
    assert m.pressure_std_bar == pytest.approx(2.5**0.5)
    assert (quiet.uptime_seconds, quiet.cycle_count, quiet.reading_count, quiet.peak_pressure_bar) == (0, 0, 1, 5)


def test_max_gap_stops_integration(unit_frame):
    m = device_metrics(unit_frame, PipelineConfig(max_gap_seconds=1200)).filter("device_id = 'd1'").first()
    assert (m.uptime_seconds, m.total_flow_volume_m3, m.cycle_count) == (1200, 22.5, 2)


def test_metrics_without_values(frame):
    on = {"motor_speed": 1000, "power_consumption": 10, "air_flow_rate": 0}
    m = device_metrics(frame([(0, "d", on)])).first()
    assert (m.uptime_seconds, m.cycle_count, m.total_flow_volume_m3, m.reading_count) == (0, 1, 0.0, 1)
    assert m.pressure_std_bar is None and m.average_pressure_bar is None and m.peak_pressure_bar is None
    assert m.specific_power_kw_per_m3h is None and m.thermal_efficiency_temp_per_kw is None


def test_ranges(frame, contract):
    df = frame([(i, "d", {PRESSURE: v}) for i, v in enumerate([16.0, 16.01, -0.01, float("nan"), None])])
    kept = [r[PRESSURE] for r in null_out_of_range(df, contract).orderBy("timestamp").collect()]
    assert kept == [16.0, None, None, None, None]
    counts = range_counts(df, contract).first()
    assert (counts.rows, counts.anomaly_rows, counts[PRESSURE]) == (5, 3, 3)


def test_resample(frame):
    df = frame([(0, "d", {PRESSURE: 1}), (4.9, "d", {PRESSURE: 3}), (5, "d", {}), (21, "d", {PRESSURE: 7})])
    rows = resample(df, "5min", SENSORS).orderBy("timestamp").collect()
    assert [(r.timestamp.minute, r[PRESSURE]) for r in rows] == [(0, 2.0), (5, None), (20, 7.0)]
    grid = fill_grid(resample(df, "5min", SENSORS), "5min").orderBy("timestamp").collect()
    assert [(r.timestamp.minute, r[PRESSURE]) for r in grid] == [(0, 2.0), (5, None), (10, None), (15, None), (20, 7.0)]


@pytest.mark.parametrize(("missing", "cells", "rows", "want"), [(0.1, 2, 10, 85.0), (0.0, 30, 10, 0.0), (0.0, 0, 10, 100.0)])
def test_score(spark, missing, cells, rows, want):
    got = spark.range(1).select(score([f"{missing}D"], str(cells), str(rows))).first()[0]
    assert got == pytest.approx(want, abs=0.01)


def test_quality_by_device(frame, contract):
    df = frame([(0, "d", {PRESSURE: 20}), (1, "d", {PRESSURE: 7}), (2, "d", {PRESSURE: 14}), (3, "d", {})])
    missing = {r["column"]: r.missing_pct for r in missing_by_device(df, contract).collect()}
    assert missing[PRESSURE] == 25.0 and missing["motor_speed"] == 100.0 and missing["timestamp"] == 0.0
    typical = {r.sensor: (r["values"], r.outside_share) for r in outside_typical(df, contract).collect()}
    assert typical[PRESSURE] == (2, 0.5) and typical["motor_speed"] == (0, None)


def test_faults(frame):
    on = {"power_consumption": 40, "motor_speed": 900, "air_flow_rate": 0}
    rows = [(m, "d", on) for m in (0, 20, 40)] + [(60, "d", {**on, "air_flow_rate": 90}), (80, "d", on)]
    assert power_without_flow(frame(rows)).count() == 4
    found = sustained_zero_flow(frame(rows), layout=Layout(slice_us=1_800_000_000)).collect()
    assert [(f.minutes, f.readings) for f in found] == [(40.0, 3)]


def test_trend(unit_frame, contract):
    daily = daily_health(unit_frame, contract).filter("device_id = 'd1'").first()
    assert (daily.uptime_seconds, daily.observed_seconds) == (4800, 10800)
    assert daily.uptime_share == pytest.approx(4 / 9) and daily.pressure_vs_target == pytest.approx(8 / 9.5 - 1)
    assert pressure_trend(daily_health(unit_frame, contract)).first().days == 1


def test_long_metrics(unit_frame):
    rows = metrics_long(device_metrics(unit_frame), names=["cycle_count"], devices=["d1"]).collect()
    assert [(r.metric, r.value) for r in rows] == [("cycle_count", 2.0)]
    assert metrics_long(device_metrics(unit_frame)).count() == 2 * len(METRICS)
    with pytest.raises(ValueError):
        metrics_long(device_metrics(unit_frame), names=["nope"])


def test_stations(spark, frame):
    many = frame([(i * 60, "d", {}) for i in range(12)])
    few = frame([(0, "x", {}), (1, "y", {})], station="s2")
    df = many.unionByName(few)
    top = busiest_slice(df).first()
    assert (top.station_id, top.rows, (top.end - top.start).total_seconds()) == ("s1", 12, 6 * 3600)
    assert busiest_readings(df).count() == 7
    meta = spark.createDataFrame([("s1", 1), ("s2", 12), ("s3", 2)], "station_id string, num_compressors bigint")
    rows = {r.station_id: r for r in check_device_counts(df, meta).collect()}
    assert rows["s1"].count_matches and rows["s1"].declared_valid
    assert not rows["s2"].declared_valid and rows["s2"].devices_seen == 2
    assert rows["s3"].devices_seen == 0 and not rows["s3"].count_matches


CHUNKS = [None, "1h", "auto"]


@pytest.mark.parametrize("strategy", ["interpolate", "ffill", "drop", "fill"])
def test_run_equals_its_operators(frame, contract, strategy):
    """The fused run gives what the operators give one after the other, however it is sliced."""
    from airmetrics.operators.flatlines import flatline_counts
    from airmetrics.operators.impute import impute
    from airmetrics.operators.quality import missing_fractions, raw_missing_columns

    rows = skewed_rows(21, 400) + [(9, "b", {PRESSURE: 99.0, "air_flow_rate": 5.0})]
    df = frame(rows).unionByName(frame([(5, "q", {PRESSURE: 1, "motor_speed": 5})], station="s2"))
    fills = {PRESSURE: 7.0}
    checked = null_out_of_range(df, contract)
    repaired = impute(checked, strategy, SENSORS, fill_values=fills)
    buckets = resample(repaired, "15min", SENSORS)
    metrics = {(r.station_id, r.device_id): r for r in device_metrics(buckets).collect()}
    counts = {r.station_id: r for r in range_counts(df, contract).collect()}
    pre = {r.station_id: r[1] for r in flatline_counts(checked, contract).collect()}
    post = {r.station_id: r[1] for r in flatline_counts(buckets, contract).collect()}
    before = {r.station_id: r for r in missing_fractions(df, raw_missing_columns(contract)).collect()}
    after = {r.station_id: r for r in missing_fractions(buckets, SENSORS).collect()}
    for chunk in CHUNKS:
        config = PipelineConfig("15min", strategy, fill_values=fills, chunk=chunk)
        run = run_pipeline(df, contract, config)
        got = {(r.station_id, r.device_id): r for r in run.devices.collect()}
        assert got.keys() == metrics.keys()
        for key, want in metrics.items():
            assert [got[key][m] for m in METRICS] == pytest.approx([want[m] for m in METRICS], nan_ok=True)
        assert run.resampled.count() == buckets.count()
        quality = {r.station_id: r for r in run.quality.collect()}
        assert quality.keys() == counts.keys()
        for station, q in quality.items():
            assert q.flat_pre == pre.get(station, 0) and q.flat_post == post.get(station, 0)
            assert q.rows_before == counts[station].rows and q.anomaly_rows == counts[station].anomaly_rows
            left = after.get(station)
            assert q.rows_after == (left.rows if left else 0)
            for s in SENSORS:
                assert q[f"oor_{s}"] == counts[station][s]
                assert q[f"missing_before_{s}"] == pytest.approx(before[station][s])
                assert q[f"missing_after_{s}"] == pytest.approx(left[s] if left else 0.0)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_rows_outside_any_series_are_counted(frame, contract, chunk):
    df = frame([(0, "d", {PRESSURE: 1}), (1, None, {PRESSURE: 99}), (None, "d", {PRESSURE: 2}), (3, "d", {})])
    run = run_pipeline(df, contract, PipelineConfig(chunk=chunk))
    q = run.quality.first()
    assert (q.rows_before, q.anomaly_rows, q[f"oor_{PRESSURE}"]) == (4, 1, 1)
    assert q.missing_before_timestamp == 0.25 and q.missing_before_device_id == 0.25
    assert q[f"missing_before_{PRESSURE}"] == 0.25
    assert run.devices.select("reading_count").first()[0] == 1


@pytest.mark.parametrize("chunk", CHUNKS)
def test_empty_station_and_emptied_station(frame, contract, chunk):
    df = frame([(0, "d", {PRESSURE: 99})])
    config = PipelineConfig(missing_strategy="drop", chunk=chunk)
    rows = {r.station_id: r for r in run_pipeline(df, contract, config, stations=["s1", "none"]).results.collect()}
    none = rows["none"]
    assert none.data_quality_score == 0.0 and none.metrics.devices == []
    assert (none.window_start, none.window_end, none.metrics.window_start) == ("", "", "")
    assert none.data_quality.extra.note == "nothing was read for this station and window"
    assert none.data_quality.missing_fraction_by_column == {} and none.data_quality.rows_before_clean == 0
    emptied = rows["s1"]
    # One bad cell in one row: half of the score is gone, nothing is missing any more.
    assert emptied.data_quality_score == 50.0 and emptied.metrics.devices == [] and emptied.window_start == ""
    assert emptied.data_quality.missing_fraction_by_column == dict.fromkeys(SENSORS, 0.0)


def test_no_rows_at_all(frame, contract):
    empty = frame([(0, "d", {})]).filter("false")
    for chunk in CHUNKS:
        run = run_pipeline(empty, contract, PipelineConfig(chunk=chunk), stations=["s1"])
        assert [r.data_quality_score for r in run.results.collect()] == [0.0]
        assert run.devices.count() == 0 and run.quality.count() == 0


def test_result_document(unit_frame, contract):
    r = run_pipeline(unit_frame, contract, PipelineConfig("1h")).results.first()
    assert r.window_start == "2024-01-01T00:00:00+00:00" and r.window_end == "2024-01-01T03:00:00+00:00"
    assert [d.device_id for d in r.metrics.devices] == ["d1", "d2"]
    assert [d.metrics.uptime_seconds for d in r.metrics.devices] == [3600, 0]
    assert r.metrics.extras.rows_processed == 5 and r.metrics.extras.data_quality_score == r.data_quality_score
    assert r.data_quality.extra.resample_rule == "1h" and r.data_quality.extra.missing_strategy == "interpolate"


def test_grid_run_has_rows_for_silence(frame, contract):
    on = {"motor_speed": 900, "power_consumption": 9, "air_flow_rate": 60, PRESSURE: 7, "discharge_temp": 40}
    df = frame([(0, "d", on), (20, "d", on)])
    plain = run_pipeline(df, contract).devices.first()
    grid = run_pipeline(df, contract, PipelineConfig(fill_grid=True))
    assert (plain.uptime_seconds, plain.reading_count) == (1200, 2)
    assert grid.resampled.count() == 5
    m = grid.devices.first()
    assert (m.uptime_seconds, m.reading_count, m.cycle_count) == (0, 5, 2)


def test_other_time_zones_are_refused(spark, unit_frame, contract):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="UTC"):
            run_pipeline(unit_frame, contract)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_uptime_never_exceeds_span(frame, contract):
    run = run_pipeline(frame(skewed_rows(2, 300)), contract)
    span = run.resampled.groupBy("device_id").agg(F.expr("max(timestamp) - min(timestamp)").alias("s"))
    for r in run.devices.join(span, "device_id").collect():
        assert r.uptime_seconds <= r.s.total_seconds()
    assert T0.year == 2024
