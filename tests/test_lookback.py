"""Stored days add up to one run over everything, whatever order they came in."""

from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.operators.impute import forward_fill, interpolate
from airmetrics.operators.metrics import METRICS
from airmetrics.operators.ranges import null_out_of_range
from airmetrics.plans.lookback import process_with_lookback, repaired_days, totals, update
from airmetrics.plans.stations import run_pipeline
from tests.conftest import SENSORS, T0


def _rows(seed, days=7, per_day=6):
    """Sparse values: gaps run over whole days, and some days have no value or no row at all."""
    rng = random.Random(seed)
    rows = []
    for day in range(days):
        for device in "ab":
            if rng.random() < 0.2:
                continue
            empty = rng.random() < 0.3
            for _ in range(rng.randint(1, per_day)):
                values = {s: None if empty or rng.random() < 0.6 else rng.uniform(0, 12) for s in SENSORS}
                rows.append((day * 1440 + rng.uniform(0, 1440), device, values))
    return rows


def _close(found, want, keys, names):
    found, want = ({tuple(r[k] for k in keys): [r[n] for n in names] for r in f.collect()} for f in (found, want))
    assert found.keys() == want.keys()
    for key, values in found.items():
        for name, x, y in zip(names, values, want[key]):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (key, name, x, y)


def _same_as_one_run(spark, readings, path, contract, config):
    want = run_pipeline(readings, contract, config).devices
    _close(totals(spark, path, contract, config), want, ("station_id", "device_id"), METRICS)


@pytest.mark.parametrize("knobs", [
    {}, {"missing_strategy": "ffill", "resample_rule": "1h"}, {"interpolate_by": "time", "max_gap_seconds": 7200},
    {"missing_strategy": "drop", "resample_rule": "1s"},
])
def test_days_add_up_in_any_order(spark, frame, contract, tmp_path, knobs):
    config = PipelineConfig(**{"resample_rule": "15min"} | knobs)
    readings = frame(_rows(len(str(knobs))))
    minute = (F.unix_micros("timestamp") - int(T0.timestamp() * 1e6)) / 60e6
    part = F.pmod(F.floor(minute / 1440), F.lit(3))
    path = str(tmp_path)
    for known in ([2], [2, 0, 1]):
        seen = readings.filter(part.isin(known))
        process_with_lookback(spark, seen, path, contract, config)
        _same_as_one_run(spark, seen, path, contract, config)
    assert process_with_lookback(spark, readings, path, contract, config).count() == 0


def test_repaired_rows_equal_one_run(spark, frame, contract, tmp_path):
    readings = frame(_rows(5))
    valid = null_out_of_range(readings, contract)
    for strategy, repair in (("ffill", forward_fill), ("interpolate", interpolate)):
        config = PipelineConfig(resample_rule="1h", missing_strategy=strategy)
        path = str(tmp_path / strategy)
        for days in (3, 9):
            process_with_lookback(spark, readings.filter(F.col("timestamp") < T0 + timedelta(days=days)), path, contract, config)
        _close(repaired_days(spark, readings, path, contract, config), repair(valid, SENSORS), ("event_id",), SENSORS)


def test_only_days_that_get_other_values_are_run_again(spark, frame, contract, tmp_path):
    full = {s: 5.0 for s in SENSORS}
    open_end = full | {"motor_speed": None}
    rows = [(day * 1440 + 60, "a", full) for day in range(6)]
    rows[1] = (1440 + 60, "a", full | {"motor_speed": 6.0})
    rows[2] = (2 * 1440 + 60, "a", open_end)  # looks back to day 1 and ahead to day 3
    config, path = PipelineConfig(resample_rule="1h"), str(tmp_path)
    run = lambda rows: sorted(
        (r.period - T0.date()).days
        for r in process_with_lookback(spark, frame(rows, event_ids=False), path, contract, config).collect()
    )
    assert run(rows) == [0, 1, 2, 3, 4, 5]
    assert run(rows) == []
    changed = [*rows[:4], (4 * 1440 + 60, "a", full | {"motor_speed": 9.0}), rows[5]]
    assert run(changed) == [4]
    changed[3] = (3 * 1440 + 60, "a", full | {"motor_speed": 7.0})
    assert run(changed) == [2, 3]
    changed.pop(1)  # the day is gone; what day 2 gets comes from day 0 now
    assert run(changed) == [1, 2]
    _same_as_one_run(spark, frame(changed, event_ids=False), path, contract, config)


def test_unfinished_and_repeated_runs(spark, frame, contract, tmp_path, monkeypatch):
    readings, config, path = frame(_rows(3)), PipelineConfig(resample_rule="1h"), str(tmp_path)
    days = readings.select("station_id", F.to_date("timestamp").alias("period")).distinct()
    pending = days.selectExpr("*", "1L AS rows", "0L AS content_high", "0L AS content_low")
    for _ in range(2):
        update(spark, readings, path, contract, config, pending, "stream-1")
    _same_as_one_run(spark, readings, path, contract, config)
    # A run that was not finished is not seen.
    monkeypatch.setattr("airmetrics.plans.lookback._summaries", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        update(spark, readings.limit(1), path, contract, config, pending.limit(1), "stream-2")
    _same_as_one_run(spark, readings, path, contract, config)


def test_ranges_of_days(spark, frame, contract, tmp_path):
    rows = [(day * 1440 + 720, "a", {s: 5.0 for s in SENSORS}) for day in range(5)]
    config, path = PipelineConfig(resample_rule="1h"), str(tmp_path)
    process_with_lookback(spark, frame(rows), path, contract, config)
    found = totals(spark, path, contract, config, "2024-01-02T00:00:00Z", "2024-01-04T00:00:00Z").first()
    assert (found.reading_count, found.uptime_seconds, found.cycle_count) == (3, 2 * 86400, 1)
    assert totals(spark, path, contract, config, start="2025-01-01").count() == 0


def test_rules_that_cross_midnight_raise(spark, frame, contract, tmp_path):
    with pytest.raises(ValueError, match="must divide a day"):
        process_with_lookback(spark, frame([]), str(tmp_path), contract, PipelineConfig(resample_rule="1w"))


def test_no_readings(spark, frame, contract, tmp_path):
    process_with_lookback(spark, frame([]), str(tmp_path), contract)
    assert totals(spark, str(tmp_path), contract).count() == 0
