"""Readings source, snapshot table and incremental runs."""

import os
import re
import shutil
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.plans.files import pending_files, process_files, process_files_with_lookback
from airmetrics.plans.incremental import pending_days, pending_range, process_pending, read_ledger
from airmetrics.plans.lookback import totals
from airmetrics.plans.stations import process, run_pipeline
from airmetrics.sources.folders import delete_files, drop_partitions_before, shared_folder
from airmetrics.sources.readings import ReadingSource, empty_readings, read_readings
from airmetrics.sources.snapshots import (
    compact_snapshots,
    read_snapshots,
    snapshot_metrics,
    snapshot_versions,
    write_snapshots,
)
from tests.conftest import SENSORS

PRESSURE = "discharge_pressure"
HOURLY = PipelineConfig("1h")


def at(hour, minute=0, day=1):
    return datetime(2024, 1, day, hour, minute, tzinfo=timezone.utc)


@pytest.fixture
def folder(spark):
    return lambda name: shared_folder(spark, name)


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("form", ["parquet", "json", "csv", "orc"])
def test_formats(spark, contract, frame, folder, form):
    rows = [(0, "d", {PRESSURE: 1, "motor_speed": 5}), (60, "d", {PRESSURE: None}), (120, "d", {PRESSURE: 3})]
    path = folder(form)
    stored = frame(rows).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    writer = stored.write.format(form)
    (writer.option("header", "true") if form == "csv" else writer).save(path)
    source = ReadingSource(path, form)
    df = read_readings(spark, source, contract, "s1", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z")
    assert [f.dataType for f in df.drop("event_id").schema] == [f.dataType for f in contract.struct_type()]
    got = sorted((r.timestamp.hour, r[PRESSURE], r.motor_speed) for r in df.collect())
    assert got == [(0, 1.0, 5.0), (1, None, None)]


def test_empty_and_incomplete_sources(spark, contract, frame):
    none = read_readings(spark, frame([(0, "d", {})]), contract, stations="nowhere")
    assert none.count() == 0 and none.drop("event_id").columns == empty_readings(spark, contract).columns
    with pytest.raises(ValueError, match="motor_speed"):
        read_readings(spark, frame([(0, "d", {})]).drop("motor_speed"), contract)
    with pytest.raises(ValueError, match="invalid datetime"):
        read_readings(spark, frame([(0, "d", {})]), contract, start="yesterday")


def test_table_source_prunes_days(spark, contract, frame, folder):
    df = frame([(m, "d", {PRESSURE: 1}) for m in (0, 1500, 3000)]).withColumn("day", F.to_date("timestamp"))
    path = folder("days")
    df.write.partitionBy("day").parquet(path)
    source = ReadingSource(path, day_column="day", units={PRESSURE: "MPa"})
    rows = read_readings(spark, source, contract, start="2024-01-02T00:00:00Z", end="2024-01-02T23:00:00Z")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert [r[PRESSURE] for r in rows.collect()] == [10.0]


def test_snapshot_upsert(spark, contract, unit_frame, folder):
    path = folder("snap")
    assert read_snapshots(spark, path).count() == 0
    results = run_pipeline(unit_frame, contract, HOURLY).results
    write_snapshots(results, path, at(10))
    write_snapshots(results, path, at(11))
    rows = read_snapshots(spark, path, "s1").collect()
    assert [(r.computed_at.hour, r.window_start) for r in rows] == [(11, "2024-01-01T00:00:00+00:00")]
    assert snapshot_versions(spark, path).count() == 2
    compact_snapshots(spark, path, ["2024-01"])
    assert snapshot_versions(spark, path).count() == 1
    assert read_snapshots(spark, path).first().metrics == rows[0].metrics


def test_snapshot_overlap(spark, contract, frame, folder):
    path = folder("snap")
    on = {PRESSURE: 7, "motor_speed": 900}
    run = run_pipeline(frame([(600, "d", on), (720, "d", on)]), contract, HOURLY, stations=["s1", "none"])
    write_snapshots(run.results, path)

    def found(**bounds):
        return {r.station_id for r in read_snapshots(spark, path, **bounds).collect()}

    assert found(start="2024-01-01T12:00:00Z") == {"s1", "none"}
    assert found(start="2024-01-01T12:01:00Z") == {"none"}
    assert found(end="2024-01-01T10:00:00Z") == {"s1", "none"}
    assert found(end="2023-12-31T10:00:00Z") == {"none"}
    assert found(station_id="none") == {"none"} and found(station_id="other") == set()


def test_snapshot_device_filter(spark, contract, frame, folder):
    path = folder("snap")
    on = {PRESSURE: 7, "motor_speed": 900}
    df = frame([(0, "a", on), (60, "a", on), (0, "b", on)])
    receipt = process(spark, df, path, contract, HOURLY).first()
    assert receipt.station_id == "s1" and receipt.snapshot_id is not None and receipt.data_quality_score > 0
    only = read_snapshots(spark, path, device_id="b").first()
    assert [d.device_id for d in only.metrics.devices] == ["b"]
    nobody = read_snapshots(spark, path, device_id="zzz").collect()
    assert len(nobody) == 1 and nobody[0].metrics.devices == []
    long = snapshot_metrics(read_snapshots(spark, path), devices=["a"], names=["reading_count"])
    assert [(r.device_id, r.value) for r in long.collect()] == [("a", 2.0)]


def test_incremental_runs_only_what_changed(spark, contract, frame, folder):
    path, ledger = folder("snap"), folder("ledger")
    on = {PRESSURE: 7, "motor_speed": 900, "air_flow_rate": 60}
    rows = [(m, "d", on) for m in (0, 60, 1440, 1500)]
    assert process_pending(spark, frame(rows), path, ledger, contract, HOURLY).count() == 2
    assert pending_days(frame(rows), read_ledger(spark, ledger)).count() == 0
    assert process_pending(spark, frame(rows), path, ledger, contract, HOURLY).count() == 0
    late = rows + [(1620, "d", on)]
    again = process_pending(spark, frame(late), path, ledger, contract, HOURLY).collect()
    assert [r.window_end for r in again] == ["2024-01-02T03:00:00+00:00"]
    # The day's older result is replaced although its window has grown.
    current = read_snapshots(spark, path).select("slot", "metrics.extras.rows_processed").collect()
    assert sorted(map(tuple, current)) == [("period 2024-01-01", 2), ("period 2024-01-02", 3)]


def test_corrected_and_vanished_days_are_pending(spark, contract, frame, folder):
    path, ledger = folder("snap"), folder("ledger")
    first = frame([(0, "d", {PRESSURE: 7}), (1440, "d", {PRESSURE: 7})], event_ids=False)
    second = frame([(0, "d", {PRESSURE: 8}), (1440, "d", {PRESSURE: 7})], event_ids=False)
    for rows in (first, second):
        process_pending(spark, rows, path, ledger, contract, HOURLY)
    # The same count, other values; and back to what an older run saw.
    assert [str(r.period) for r in pending_days(first, read_ledger(spark, ledger)).collect()] == ["2024-01-01"]
    gone = frame([(1440, "d", {PRESSURE: 7})], event_ids=False)
    assert process_pending(spark, gone, path, ledger, contract, HOURLY).count() == 1
    day = read_snapshots(spark, path).filter("slot = 'period 2024-01-01'").first()
    assert (day.window_start, day.metrics.devices, day.data_quality_score) == ("", [], 0.0)
    assert process_pending(spark, gone, path, ledger, contract, HOURLY).count() == 0


def test_the_scan_is_cut_to_the_pending_days(spark, frame, folder):
    path, ledger = folder("rows"), folder("ledger")
    frame([(0, "d", {PRESSURE: 7}), (1440, "d", {PRESSURE: 7})]).write.parquet(path)
    rows = spark.read.parquet(path)
    planned = pending_days(rows, read_ledger(spark, ledger)).filter("period = '2024-01-02'")
    plan = pending_range(rows, planned)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2024-01-02" in plan


def test_compaction_keeps_what_comes_meanwhile(spark, contract, frame, folder, monkeypatch):
    path = folder("snap")
    rows = frame([(0, "d", {PRESSURE: 7, "motor_speed": 900})])
    for _ in range(2):
        write_snapshots(run_pipeline(rows, contract, HOURLY).results, path)
    late = run_pipeline(frame([(60, "d", {PRESSURE: 8})], station="s2"), contract, HOURLY).results

    def delete(session, files):
        write_snapshots(late, path)
        delete_files(session, files)

    monkeypatch.setattr("airmetrics.sources.snapshots.delete_files", delete)
    compact_snapshots(spark, path)
    assert sorted(r.station_id for r in snapshot_versions(spark, path).collect()) == ["s1", "s2"]


def test_an_empty_version_is_not_shown_for_a_later_one(spark, contract, frame, folder):
    path, ledger = folder("snap"), folder("ledger")
    march = 60 * 24 * 64
    full, none = frame([(march, "d", {PRESSURE: 7})]), frame([])
    for rows in (full, none, full):
        process_pending(spark, rows, path, ledger, contract, HOURLY)
    assert read_snapshots(spark, path, end="2024-02-15T00:00:00Z").count() == 0
    assert read_snapshots(spark, path, end="2024-03-15T00:00:00Z").first().window_start.startswith("2024-03-05")


def test_json_lines_under_old_names(spark, contract, folder):
    path = folder("json")
    line = '{"timestamp": "2024-01-01T00:00:00Z", "station_id": "s", "device_id": "d", "pressure_bar": 7.5, "rpm": "900"%s}'
    spark.createDataFrame([(line % "",), (line % ', "discharge_pressure": 6, "note": 1',)], "value string").write.text(path)
    source = ReadingSource(path, format="json")
    rows = read_readings(spark, source, contract).orderBy(PRESSURE).collect()
    assert [(r[PRESSURE], r.motor_speed) for r in rows] == [(6.0, 900.0), (7.5, 900.0)]
    with pytest.raises(ValueError, match="note"):
        read_readings(spark, source, contract, strict=True)


def test_rows_without_station_are_reported(spark, contract, frame):
    rows = frame([(0, "d", {PRESSURE: 7})]).unionByName(frame([(0, "d", {}), (None, None, {})], station=None))
    run = run_pipeline(rows, contract, HOURLY)
    got = {r.station_id: (r.rows_before, r.missing_before_station_id) for r in run.quality.collect()}
    assert got == {"s1": (1, 0.0), None: (2, 1.0)}
    assert [r.station_id for r in run.results.collect()] == ["s1"]


def test_a_run_that_died_is_repeated(spark, contract, frame, folder):
    ledger = folder("ledger")
    rows = frame([(0, "d", {PRESSURE: 7})])
    pending_days(rows, read_ledger(spark, ledger)).withColumn("run_id", F.lit("dead")).write.parquet(f"{ledger}/planned")
    assert pending_days(rows, read_ledger(spark, ledger)).count() == 1


def test_retention(spark, folder):
    path = folder("kept")
    spark.range(3).withColumn("d", F.expr("date_add(date'2024-01-01', int(id))")).write.partitionBy("d").parquet(path)
    assert drop_partitions_before(spark, path, "d", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert spark.read.parquet(path).count() == 1
    assert drop_partitions_before(spark, folder("nothing"), "d", "2024-01-03") == []
    assert SENSORS


def _store(frame, folder, name, rows):
    frame(rows).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def _data_files(folder):
    return sorted(Path(folder).rglob("part-*.parquet"))


def test_files_are_read_once(spark, contract, frame, folder):
    at_ = [(m, "d", {PRESSURE: 7, "motor_speed": 900}) for m in (0, 60, 1440, 1500)]
    base, path, ledger = f"{folder('odd')} a%20[b]+c", folder("snap"), folder("ledger")
    source = ReadingSource(f"{re.sub(r'([][])', r'\\\1', base)}/*")
    _store(frame, base, "one", at_[:2])
    _store(frame, base, "two", at_[2:])
    assert process_files(spark, source, path, ledger, contract, HOURLY).count() == 2
    # Unchanged files are not opened again: their content may as well be gone.
    for file in _data_files(base):
        stat = file.stat()
        file.write_bytes(bytes(stat.st_size))
        os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert process_files(spark, source, path, ledger, contract, HOURLY).count() == 0
    # A third file with a day of its own: only that file is read.
    _store(frame, base, "three", [(3000, "d", {PRESSURE: 7})])
    again = process_files(spark, source, path, ledger, contract, HOURLY).collect()
    assert [r.window_start[:10] for r in again] == ["2024-01-03"]


def test_replaced_and_deleted_files_are_found(spark, contract, frame, folder):
    rows = [(m, "d", {PRESSURE: 7, "motor_speed": 900}) for m in (0, 60, 1440, 1500)]
    base, path, ledger = folder("rows"), folder("snap"), folder("ledger")
    source = ReadingSource(f"{base}/*")
    _store(frame, base, "one", rows[:3])
    _store(frame, base, "two", rows[3:])
    process_files(spark, source, path, ledger, contract, HOURLY)

    def days(source=source, contract=contract):
        return sorted((str(r.period), r.rows) for r in pending_files(spark, source, ledger, contract)[0].collect())

    assert days() == []
    # Both files replaced; the first day holds what it held.
    _store(frame, base, "one", rows[:2])
    _store(frame, base, "two", rows[2:])
    assert days() == [("2024-01-02", 2)]  # the builder deals event ids anew, so these rows differ
    process_files(spark, source, path, ledger, contract, HOURLY)
    shutil.rmtree(f"{base}/two")
    assert days() == [("2024-01-02", 0)]
    process_files(spark, source, path, ledger, contract, HOURLY)
    gone = read_snapshots(spark, path).filter("slot = 'period 2024-01-02'").first()
    assert (gone.window_start, gone.metrics.devices) == ("", [])
    # Another unit makes other readings of the same bytes.
    assert days(replace(source, units={PRESSURE: "MPa"})) == [("2024-01-01", 2)]


def test_files_with_folder_columns_and_days_that_add_up(spark, contract, frame, folder):
    rows = [(m, "d", {PRESSURE: 7, "motor_speed": 900, "air_flow_rate": 60}) for m in range(0, 4000, 50)]
    base, path = folder("days"), folder("lookback")
    source = ReadingSource(base, day_column="day")
    stored = frame(rows).withColumn("day", F.to_date("timestamp"))
    early, late = stored.filter("day < '2024-01-03'"), stored.filter("day >= '2024-01-03'")
    late.write.partitionBy("day").parquet(base)
    assert process_files_with_lookback(spark, source, path, contract, HOURLY).count() == 1
    early.write.mode("append").partitionBy("day").parquet(base)
    ran = process_files_with_lookback(spark, source, path, contract, HOURLY).collect()
    assert {str(r.period) for r in ran} >= {"2024-01-01", "2024-01-02"}
    assert process_files_with_lookback(spark, source, path, contract, HOURLY).count() == 0
    (got,) = totals(spark, path, contract, HOURLY).collect()
    (whole,) = run_pipeline(frame(rows), contract, HOURLY).devices.collect()
    for name in ("uptime_seconds", "cycle_count", "total_flow_volume_m3", "reading_count"):
        assert got[name] == whole[name]


def test_only_folders_have_files(spark, contract, folder):
    with pytest.raises(ValueError, match="path"):
        pending_files(spark, ReadingSource(table="readings"), folder("ledger"), contract)


def test_reads_are_cut_at_both_ends(spark, contract, frame, folder):
    path = folder("snap")
    on = {PRESSURE: 7, "motor_speed": 900}
    day = 1440
    spans = {"jan": (0, day), "jan_to_mar": (0, 70 * day), "mar": (65 * day, 66 * day), "may": (130 * day, 131 * day)}
    for station, minutes in spans.items():
        write_snapshots(run_pipeline(frame([(m, "d", on) for m in minutes], station), contract, HOURLY).results, path)
    empty = frame([(0, "d", on)]).limit(0)
    write_snapshots(run_pipeline(empty, contract, HOURLY, stations=["none"]).results, path)

    def found(**span):
        return {r.station_id for r in read_snapshots(spark, path, **span).collect()}

    between = {"start": "2024-02-10T00:00:00Z", "end": "2024-03-31T00:00:00Z"}
    assert found(**between) == {"jan_to_mar", "mar", "none"}
    assert found(start="2024-04-01T00:00:00Z") == {"may", "none"}
    assert found(end="2024-01-31T00:00:00Z") == {"jan", "jan_to_mar", "none"}
    compact_snapshots(spark, path, ["2024-01"])
    assert found() == {*spans, "none"}
    # Files of other months are not opened: they may as well be broken.
    for months in ("window_month=2024-01/last_month=2024-01", "window_month=2024-05/last_month=2024-05"):
        for file in Path(path, months).glob("part-*.parquet"):
            file.write_bytes(bytes(file.stat().st_size))
    assert found(**between) == {"jan_to_mar", "mar", "none"}


def test_receipts_open_new_files_only(spark, contract, frame, folder):
    path = folder("snap")
    rows = frame([(0, "d", {PRESSURE: 7})])
    process(spark, rows, path, contract, HOURLY)
    (old,) = Path(path).rglob("part-*.parquet")
    content = old.read_bytes()
    old.write_bytes(bytes(len(content)))
    os.utime(old, (0, 0))
    assert process(spark, rows, path, contract, HOURLY).count() == 1
    old.write_bytes(content)
    assert snapshot_versions(spark, path).count() == 2
