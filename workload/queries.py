"""One Spark query per operator. Results are flat; doubles are rounded for comparison."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.compressed_air import COLUMN_ALIASES
from airmetrics.config import PipelineConfig
from airmetrics.contract import Contract
from airmetrics.operators.evolve import (
    contract_checks,
    convert_units,
    normalise_types,
    rename_aliases,
    select_known,
)
from airmetrics.operators.faults import power_without_flow, sustained_zero_flow
from airmetrics.operators.flatlines import flatline_counts, flatline_periods
from airmetrics.operators.gaps import reading_gaps
from airmetrics.operators.impute import drop_missing, fill_constant, forward_fill, interpolate
from airmetrics.operators.metrics import METRICS, device_metrics, metrics_long, station_window
from airmetrics.operators.quality import (
    missing_by_device,
    missing_fractions,
    outside_typical,
    range_counts,
    raw_missing_columns,
)
from airmetrics.operators.ranges import null_out_of_range
from airmetrics.operators.resample import fill_grid, resample
from airmetrics.operators.rollups import means
from airmetrics.operators.series import Layout
from airmetrics.operators.stations import busiest_readings, busiest_slice, check_device_counts
from airmetrics.operators.trends import daily_health, pressure_trend
from airmetrics.plans.files import pending_files, process_files
from airmetrics.plans.incremental import pending_days, process_pending, read_ledger
from airmetrics.plans.lookback import process_with_lookback, totals
from airmetrics.plans.rollups import drop_replaced, read_rollups, update_rollups
from airmetrics.plans.stations import process, run_pipeline
from airmetrics.sources.events import dead_letters, good_events, long_readings, parse_events
from airmetrics.sources.folders import shared_folder
from airmetrics.sources.readings import ReadingSource, read_readings
from airmetrics.sources.snapshots import (
    compact_snapshots,
    read_snapshots,
    snapshot_metrics,
    write_snapshots,
)
from airmetrics.streaming.consumer import (
    StreamTables,
    batch_handler,
    batch_log,
    compact_bronze,
    day_totals,
    late_days,
    processing_status,
    replay,
    replay_late,
    start_stream,
)
from airmetrics.streaming.windows import dedupe_stream, window_aggregates
from workload.tables import CONTRACT, SENSORS, as_raw, raw_event_stream, readings, stations

Query = Callable[[SparkSession, str], DataFrame]
HOURLY = PipelineConfig(resample_rule="1h")
ROW_KEYS = ("event_id", "timestamp", "station_id", "device_id")
BUCKET_KEYS = ("station_id", "device_id", "timestamp")


def rounded(value: Column, digits: int = 6) -> Column:
    """Engines sum in different orders; the nudge keeps exact halves from rounding both ways."""
    return F.round(value + F.lit(1e-10), digits)


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Comparable output: timestamps without zone, doubles rounded."""
    out = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType
        value = F.col(name)
        if isinstance(kind, T.TimestampType):
            value = value.cast("timestamp_ntz")
        elif isinstance(kind, T.DoubleType):
            value = rounded(value)
        out.append(value.alias(name))
    return df.select(*out)


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_out_of_range(readings(spark, sf_dir), CONTRACT)


def clean(spark: SparkSession, sf_dir: str, rule: str = "1h") -> DataFrame:
    rows = valid(spark, sf_dir)
    return resample(interpolate(rows, SENSORS, Layout.of(rows, "auto")), rule, SENSORS)


# -- sources and contract -----------------------------------------------------------------


def read_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_readings(
        spark,
        readings(spark, sf_dir),
        CONTRACT,
        stations=["station_1", "station_3"],
        start="2024-01-05T00:00:00Z",
        end="2024-01-20T12:00:00Z",
    )
    return flat(rows, *ROW_KEYS, *SENSORS)


OWN_CONTRACT = """{
  "version": "plant-2",
  "tables": {"sensor_readings": {"columns": {
    "timestamp": {"type": "datetime", "required": true},
    "station_id": {"type": "string", "required": true},
    "device_id": {"type": "string", "required": true},
    "discharge_pressure": {"type": "float", "unit": "bar", "valid_range": {"min": 2, "max": 6.5}},
    "motor_speed": {"type": "float", "unit": "RPM", "valid_range": {"min": 0, "max": 3000}}
  }}}
}"""


def contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings under a contract given as JSON: its columns only, its ranges, counts before and after the cut."""
    contract = Contract.from_dict(json.loads(OWN_CONTRACT))
    rows = select_known(readings(spark, sf_dir), contract)
    before = range_counts(rows, contract)
    after = null_out_of_range(rows, contract).groupBy("station_id").agg(
        *[F.count(s).alias(f"{s}_kept") for s in contract.sensors]
    )
    return flat(before.join(after, "station_id"))


def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as text with damaged numbers, checked against the contract."""
    rows = readings(spark, sf_dir)
    damaged = rows.select(
        "timestamp",
        "station_id",
        F.when(F.col("event_id") % 11 != 0, F.col("device_id")).alias("device_id"),
        *[
            F.when(F.col("event_id") % (20 + i) == 0, F.lit("n/a")).otherwise(F.col(s).cast("string")).alias(s)
            for i, s in enumerate(SENSORS)
        ],
    )
    return contract_checks(damaged, CONTRACT)


def contract_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table: other names, pressure in kPa, temperature in Fahrenheit, text numbers."""
    old = readings(spark, sf_dir).selectExpr(
        *ROW_KEYS,
        "discharge_pressure * 100 as pressure_bar",
        "air_flow_rate as flow_m3h",
        "cast(power_consumption as string) as power_kw",
        "motor_speed as rpm",
        "discharge_temp * 9 / 5 + 32 as temperature_c",
        "'x' as operator_note",
    )
    rows = select_known(rename_aliases(old), CONTRACT)
    rows = convert_units(
        normalise_types(rows, CONTRACT), CONTRACT, {"discharge_pressure": "kPa", "discharge_temp": "°F"}
    )
    return flat(rows, *ROW_KEYS, *SENSORS)


# -- validation and quality ---------------------------------------------------------------


def range_nulling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(valid(spark, sf_dir), *ROW_KEYS, *SENSORS)


def oor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_counts(readings(spark, sf_dir), CONTRACT).drop("anomaly_rows")


def anomaly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_counts(readings(spark, sf_dir), CONTRACT).select("station_id", "rows", "anomaly_rows")


def missing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(missing_fractions(readings(spark, sf_dir), raw_missing_columns(CONTRACT)))


def missing_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(valid(spark, sf_dir), "1h", SENSORS)
    return flat(missing_fractions(rows, SENSORS))


def missing_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(missing_by_device(readings(spark, sf_dir), CONTRACT))


def typical_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(outside_typical(readings(spark, sf_dir), CONTRACT))


def flatline_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark, sf_dir)
    return flatline_counts(rows, CONTRACT, Layout.of(rows, "auto"))


def flatline_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark, sf_dir)
    return flat(flatline_periods(rows, CONTRACT, Layout.of(rows, "auto")))


def flatline_list_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark, sf_dir)
    return flat(flatline_periods(rows, CONTRACT, Layout.of(rows, "1d")))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readings(spark, sf_dir)
    return flat(reading_gaps(rows, 3.0, Layout.of(rows, "auto")))


def gaps_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(reading_gaps(readings(spark, sf_dir), 3.0, Layout.of(readings(spark, sf_dir), "1d")))


def _weak_flow_as_zero(df: DataFrame) -> DataFrame:
    """The test readings have no zero flow under power; a weak flow stands in for it."""
    return df.withColumn("air_flow_rate", F.expr("case when air_flow_rate < 60 then 0D else air_flow_rate end"))


def faults_power_without_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = power_without_flow(_weak_flow_as_zero(readings(spark, sf_dir)))
    return flat(rows, *ROW_KEYS, "air_flow_rate", "power_consumption")


def faults_zero_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _weak_flow_as_zero(resample(valid(spark, sf_dir), "1h", SENSORS))
    return flat(sustained_zero_flow(rows, HOURLY, 60))


# -- repair and resampling ----------------------------------------------------------------


def missing_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(drop_missing(valid(spark, sf_dir), SENSORS), *ROW_KEYS, *SENSORS)


def missing_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = {"discharge_pressure": 7.5, "discharge_temp": 20.0}
    return flat(fill_constant(valid(spark, sf_dir), fills), *ROW_KEYS, *SENSORS)


def _repaired(method: Callable[..., DataFrame], chunk: str, **options: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = valid(spark, sf_dir)
        return flat(method(rows, SENSORS, Layout.of(rows, chunk), **options), *ROW_KEYS, *SENSORS)

    return query


def _resampled(rule: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(resample(valid(spark, sf_dir), rule, SENSORS), *BUCKET_KEYS, *SENSORS)

    return query


def resample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(valid(spark, sf_dir), "1h", SENSORS)
    return flat(fill_grid(rows, "1h"), *BUCKET_KEYS, *SENSORS)


# -- metrics ------------------------------------------------------------------------------


def _metrics(*names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(device_metrics(clean(spark, sf_dir), HOURLY), "station_id", "device_id", *names)

    return query


def _run_devices(strategy: str, chunk: str, rule: str = "1h", **knobs: object) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = PipelineConfig(resample_rule=rule, missing_strategy=strategy, chunk=chunk, **knobs)
        run = run_pipeline(readings(spark, sf_dir), CONTRACT, config)
        return flat(run.devices, "station_id", "device_id", *METRICS)

    return query


def window_of_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(station_window(clean(spark, sf_dir)))


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = device_metrics(clean(spark, sf_dir), HOURLY)
    names = ("uptime_seconds", "average_pressure_bar", "cycle_count")
    return flat(metrics_long(wide, stations=["station_0", "station_2"], names=names))


def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(daily_health(clean(spark, sf_dir), CONTRACT, HOURLY))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(pressure_trend(daily_health(clean(spark, sf_dir), CONTRACT, HOURLY)))


# -- station runs and snapshots -----------------------------------------------------------


def clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_pipeline(readings(spark, sf_dir), CONTRACT, HOURLY)
    return flat(run.resampled, *BUCKET_KEYS, *SENSORS)


def _report(chunk: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = PipelineConfig(resample_rule="1h", chunk=chunk)
        return flat(run_pipeline(readings(spark, sf_dir), CONTRACT, config).quality)

    return query


def dq_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = run_pipeline(readings(spark, sf_dir), CONTRACT, HOURLY)
    return run.quality.select("station_id", F.round("data_quality_score", 2).alias("score"))


def station_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored documents, flattened to one row per device; one asked station has no rows."""
    asked = ["station_0", "station_1", "station_2", "station_3", "station_9"]
    run = run_pipeline(readings(spark, sf_dir), CONTRACT, HOURLY, stations=asked)
    rows = run.results.select(
        "station_id",
        "window_start",
        "window_end",
        F.col("metrics.extras.rows_processed").alias("rows_processed"),
        F.col("data_quality.rows_before_clean").alias("rows_before_clean"),
        F.explode_outer("metrics.devices").alias("d"),
    )
    return flat(
        rows.select(
            "station_id",
            "window_start",
            "window_end",
            "rows_processed",
            "rows_before_clean",
            F.col("d.device_id").alias("device_id"),
            F.col("d.metrics.uptime_seconds").alias("uptime_seconds"),
            F.col("d.metrics.total_flow_volume_m3").alias("total_flow_volume_m3"),
        )
    )


def busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(busiest_slice(readings(spark, sf_dir)))


def busiest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest station's first hours, run as its own window."""
    run = run_pipeline(busiest_readings(readings(spark, sf_dir)), CONTRACT, HOURLY)
    return flat(run.devices, "station_id", "device_id", "reading_count", "uptime_seconds", "average_pressure_bar")


def process_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "snapshots")
    rows = process(spark, readings(spark, sf_dir), path, CONTRACT, HOURLY)
    return rows.select(
        "station_id", "window_start", "window_end", F.round("data_quality_score", 2).alias("score")
    )


def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows stored twice, then compacted: one current row per window, the later one."""
    path = shared_folder(spark, "snapshots")
    results = run_pipeline(readings(spark, sf_dir), CONTRACT, HOURLY).results
    for hour in (1, 2):
        write_snapshots(results, path, datetime(2024, 2, 1, hour, tzinfo=timezone.utc))
    compact_snapshots(spark, path)
    rows = read_snapshots(spark, path)
    return flat(
        rows.select(
            "station_id",
            "window_start_ts",
            "window_end_ts",
            "computed_at",
            F.col("metrics.extras.rows_processed").alias("rows_processed"),
            F.size("metrics.devices").cast("bigint").alias("devices"),
        )
    )


def _daily_snapshots(spark: SparkSession, sf_dir: str) -> str:
    path, ledger = shared_folder(spark, "snapshots"), shared_folder(spark, "ledger")
    process_pending(spark, readings(spark, sf_dir), path, ledger, CONTRACT, HOURLY)
    return path


def snapshot_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _daily_snapshots(spark, sf_dir)
    rows = read_snapshots(spark, path, start="2024-01-10T00:00:00Z", end="2024-01-12T12:00:00Z")
    return flat(
        rows.select(
            "station_id",
            "window_start_ts",
            "window_end_ts",
            F.col("metrics.extras.rows_processed").alias("rows_processed"),
        )
    )


def snapshot_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "snapshots")
    process(spark, readings(spark, sf_dir), path, CONTRACT, HOURLY)
    rows = read_snapshots(spark, path, station_id="station_1", device_id="compressor_2")
    return flat(snapshot_metrics(rows).drop("window_start", "window_end"))


def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days left to do after a run that had seen the readings before 20 January only."""
    rows = readings(spark, sf_dir)
    path, ledger = shared_folder(spark, "snapshots"), shared_folder(spark, "ledger")
    first = rows.filter(F.col("timestamp") < F.lit(datetime(2024, 1, 20, 6, tzinfo=timezone.utc)))
    process_pending(spark, first, path, ledger, CONTRACT, HOURLY)
    return pending_days(rows, read_ledger(spark, ledger)).select("station_id", "period", "rows")


def _corrected(rows: DataFrame) -> DataFrame:
    """Other values on 10 January, as many rows as before."""
    changed = F.to_date("timestamp") == F.lit("2024-01-10").cast("date")
    return rows.withColumn("motor_speed", F.when(changed, F.col("motor_speed") + 1).otherwise(F.col("motor_speed")))


def incremental_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to do again after a run, when one was corrected without a change of its row count."""
    rows = readings(spark, sf_dir)
    path, ledger = shared_folder(spark, "snapshots"), shared_folder(spark, "ledger")
    process_pending(spark, rows, path, ledger, CONTRACT, HOURLY)
    return pending_days(_corrected(rows), read_ledger(spark, ledger)).select("station_id", "period", "rows")


def incremental_reverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day was run, corrected and run again; then the correction is taken back, and one day is gone."""
    rows = readings(spark, sf_dir)
    path, ledger = shared_folder(spark, "snapshots"), shared_folder(spark, "ledger")
    process_pending(spark, rows, path, ledger, CONTRACT, HOURLY)
    process_pending(spark, _corrected(rows), path, ledger, CONTRACT, HOURLY)
    now = rows.filter(F.to_date("timestamp") != F.lit("2024-01-12").cast("date"))
    return pending_days(now, read_ledger(spark, ledger)).select("station_id", "period", "rows")


def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days left to do after a run, when a file came to the source and another was replaced."""
    rows = readings(spark, sf_dir)
    source, path, ledger = (shared_folder(spark, n) for n in ("source", "snapshots", "ledger"))
    day, late = F.to_date("timestamp"), F.col("timestamp") >= F.lit(datetime(2024, 1, 20, 6, tzinfo=timezone.utc))
    tenth = day == F.lit("2024-01-10").cast("date")
    rows.filter(~late & ~tenth).write.parquet(f"{source}/part=early")
    rows.filter(tenth).write.parquet(f"{source}/part=tenth")
    files = ReadingSource(source)
    process_files(spark, files, path, ledger, CONTRACT, HOURLY)
    rows.filter(late).write.parquet(f"{source}/part=late")
    _corrected(rows.filter(tenth)).write.mode("overwrite").parquet(f"{source}/part=tenth")
    return pending_files(spark, files, ledger, CONTRACT)[0].select("station_id", "period", "rows")


def _rolled_up(rule: str) -> Query:
    """Resampled readings out of stored partial sums."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_folder(spark, "rollups")
        update_rollups(spark, readings(spark, sf_dir), path, CONTRACT)
        rows = means(read_rollups(spark, path, rule, CONTRACT), SENSORS)
        return flat(rows, *BUCKET_KEYS, *SENSORS)

    return query


def rollup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stations' days from hours, the first and last one cut, with counts and extremes."""
    path = shared_folder(spark, "rollups")
    update_rollups(spark, readings(spark, sf_dir), path, CONTRACT)
    bounds = ("2024-01-05T06:00:00Z", "2024-01-20T13:00:00Z")
    rows = read_rollups(spark, path, "1d", CONTRACT, ["station_1", "station_3"], *bounds)
    parts = [f"{s}_{part}" for s in SENSORS for part in ("n", "min", "max")]
    return flat(rows, *BUCKET_KEYS, "rows", *parts)


def rollup_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows came and a day was corrected: only these days are done again, then old versions go."""
    rows, path = readings(spark, sf_dir), shared_folder(spark, "rollups")
    early = rows.filter(F.col("timestamp") < F.lit(datetime(2024, 1, 20, 6, tzinfo=timezone.utc)))
    update_rollups(spark, early, path, CONTRACT)
    done = update_rollups(spark, _corrected(rows), path, CONTRACT)
    drop_replaced(spark, path)
    days = means(read_rollups(spark, path, "1d", CONTRACT), SENSORS)
    again = done.select("station_id", F.col("period").cast("timestamp").alias("timestamp"), F.lit(True).alias("again"))
    marked = days.join(again, ["station_id", "timestamp"], "left")
    return flat(marked.withColumn("again", F.coalesce("again", F.lit(False))), *BUCKET_KEYS, *SENSORS, "again")


def _lookback(strategy: str) -> Query:
    """Metrics of all history out of stored days; the later days came first, one of them in parts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = readings(spark, sf_dir), shared_folder(spark, "days")
        config = PipelineConfig(resample_rule="1h", missing_strategy=strategy)
        late = rows.filter(F.col("timestamp") >= F.lit(datetime(2024, 1, 20, 6, tzinfo=timezone.utc)))
        process_with_lookback(spark, late, path, CONTRACT, config)
        process_with_lookback(spark, rows, path, CONTRACT, config)
        return flat(totals(spark, path, CONTRACT, config), "station_id", "device_id", *METRICS)

    return query


def _with_nulls(rows: DataFrame) -> DataFrame:
    """Some rows lose their station, device or time; some of the others lie next to them."""
    n = F.col("event_id")
    return rows.withColumns(
        {
            "station_id": F.when(n % 13 != 0, F.col("station_id")),
            "device_id": F.when(n % 17 != 0, F.col("device_id")),
            "timestamp": F.when(n % 19 != 0, F.col("timestamp")),
        }
    )


def _null_rows(spark: SparkSession, sf_dir: str, chunk: str | None) -> DataFrame:
    """Interpolated and forward filled readings, some of which belong to no series."""
    rows = null_out_of_range(_with_nulls(readings(spark, sf_dir)), CONTRACT)
    layout = Layout.of(rows, chunk)
    lines = interpolate(rows, SENSORS, layout).select(*ROW_KEYS, *SENSORS)
    steps = forward_fill(rows, SENSORS, layout).select("event_id", *[F.col(s).alias(f"ffill_{s}") for s in SENSORS])
    return flat(lines.join(steps, "event_id"), *ROW_KEYS, *SENSORS, *[f"ffill_{s}" for s in SENSORS])


def null_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_rows(spark, sf_dir, None)


def null_rows_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_rows(spark, sf_dir, "1d")


def dq_report_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is counted in some report, those without a station under the null station."""
    rows = _with_nulls(readings(spark, sf_dir))
    report = run_pipeline(rows, CONTRACT, HOURLY).quality
    shares = ("station_id", "device_id", "timestamp")
    return report.select(
        "station_id", "rows_before", *[rounded(F.col(f"missing_before_{c}")).alias(f"missing_{c}") for c in shares]
    )


def snapshot_late_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is stored without rows, later with rows; a read that ends the month before shows neither."""
    rows = readings(spark, sf_dir)
    path, ledger = shared_folder(spark, "snapshots"), shared_folder(spark, "ledger")
    process_pending(spark, rows, path, ledger, CONTRACT, HOURLY)
    process_pending(spark, rows.filter("timestamp < '2024-01-15'"), path, ledger, CONTRACT, HOURLY)
    process_pending(spark, rows, path, ledger, CONTRACT, HOURLY)
    compact_snapshots(spark, path)
    before = read_snapshots(spark, path, end="2023-12-31T00:00:00Z").select(F.lit("before").alias("read"), "station_id", "slot")
    after = read_snapshots(spark, path, start="2024-01-15T00:00:00Z").select(F.lit("after").alias("read"), "station_id", "slot")
    return before.unionByName(after)


def read_json_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings stored as JSON lines under old column names, read back through the contract."""
    folder = shared_folder(spark, "json")
    old = {c: a for a, c in COLUMN_ALIASES.items() if c in SENSORS}
    rows = readings(spark, sf_dir).withColumnsRenamed(old)
    rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).write.json(folder)
    back = read_readings(spark, ReadingSource(folder, format="json"), CONTRACT, strict=True)
    return flat(back.withColumn("event_id", F.col("event_id").cast("long")), *ROW_KEYS, *SENSORS)


def empty_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station without readings: an empty report, stored and read back."""
    contract = CONTRACT
    rows = read_readings(spark, readings(spark, sf_dir), contract, stations="station_99")
    path = shared_folder(spark, "snapshots")
    process(spark, rows, path, contract, HOURLY, stations=["station_99"])
    return read_snapshots(spark, path, "station_99").select(
        "station_id", "window_start", "window_end", "data_quality_score", F.size("metrics.devices").alias("devices")
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_device_counts(readings(spark, sf_dir), stations(spark, sf_dir))


# -- streams ------------------------------------------------------------------------------


def _land(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over what is there and read back what it wrote."""
    base = shared_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_events(raw_event_stream(spark, sf_dir), CONTRACT)
    return _land(dead_letters(parsed), spark, "dead").select("event_id", "reason")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = good_events(parse_events(raw_event_stream(spark, sf_dir), CONTRACT))
    return flat(_land(dedupe_stream(good), spark, "deduped"), *ROW_KEYS, *SENSORS)


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = good_events(parse_events(raw_event_stream(spark, sf_dir), CONTRACT))
    windows = window_aggregates(dedupe_stream(good), CONTRACT, "1h", delay=None)
    return flat(_land(windows, spark, "windows"))


def stream_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = good_events(parse_events(raw_event_stream(spark, sf_dir), CONTRACT))
    rows = long_readings(_land(good, spark, "good"), CONTRACT)
    return rows.groupBy("station_id", "sensor").agg(
        F.count(F.lit(1)).alias("readings"), F.count("value").alias("values")
    )


def _consumed(spark: SparkSession, sf_dir: str) -> StreamTables:
    tables = StreamTables(shared_folder(spark, "consumer"), CONTRACT)
    start_stream(raw_event_stream(spark, sf_dir), tables.base, CONTRACT, HOURLY).awaitTermination()
    return tables


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = processing_status(spark, _consumed(spark, sf_dir))
    return flat(
        rows, "received", "processed", "errors", "missing_field", "bad_type", "corrupt", "last_event_at"
    )


def _stream_day_metrics(rows: DataFrame) -> DataFrame:
    days = rows.select("window_start_ts", "station_id", F.explode("metrics.devices").alias("d"))
    return flat(
        days.select(
            "station_id",
            F.to_date("window_start_ts").alias("day"),
            F.col("d.device_id").alias("device_id"),
            F.col("d.metrics.reading_count").alias("reading_count"),
            F.col("d.metrics.uptime_seconds").alias("uptime_seconds"),
            F.col("d.metrics.total_flow_volume_m3").alias("total_flow_volume_m3"),
        )
    )


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics the consumer stored."""
    return _stream_day_metrics(read_snapshots(spark, _consumed(spark, sf_dir).snapshots))


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some days rebuilt from bronze."""
    tables = _consumed(spark, sf_dir)
    return _stream_day_metrics(replay(spark, tables, "2024-01-08T00:00:00Z", "2024-01-09T23:59:59Z", HOURLY))


def stream_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all streamed history; the second micro-batch brings the earlier events."""
    tables = StreamTables(shared_folder(spark, "consumer"), CONTRACT)
    handle = batch_handler(tables, HOURLY, lookback=True)
    early = F.col("timestamp") < F.lit(datetime(2024, 1, 20, 6, tzinfo=timezone.utc))
    for batch_id, part in enumerate((~early, early)):
        raw = as_raw(readings(spark, sf_dir).filter(part))
        handle(raw.withColumn("ingested_at", F.current_timestamp()), batch_id)
    return flat(day_totals(spark, tables, HOURLY), "station_id", "device_id", *METRICS)


def _deliver(spark: SparkSession, sf_dir: str, parts: list, **options: object) -> StreamTables:
    """A consumer that has seen the events in micro-batches, one per condition."""
    tables = StreamTables(shared_folder(spark, "consumer"), CONTRACT)
    handle = batch_handler(tables, HOURLY, **options)
    for batch_id, part in enumerate(parts):
        raw = as_raw(readings(spark, sf_dir).filter(part))
        handle(raw.withColumn("ingested_at", F.current_timestamp()), batch_id)
    return tables


def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some days rebuilt from bronze whose micro-batches were rewritten as few files, twice."""
    parts = [F.col("event_id") % 5 == n for n in range(5)]
    tables = _deliver(spark, sf_dir, parts[:4], snapshots=False)
    compact_bronze(spark, tables, min_batches=2)
    last = as_raw(readings(spark, sf_dir).filter(parts[4])).withColumn("ingested_at", F.current_timestamp())
    batch_handler(tables, HOURLY, snapshots=False)(last, 4)
    compact_bronze(spark, tables, min_batches=1)
    return _stream_day_metrics(replay(spark, tables, "2024-01-08T00:00:00Z", "2024-01-09T23:59:59Z", HOURLY))


def _late(spark: SparkSession, sf_dir: str, **options: object) -> StreamTables:
    """The events before 20 January come in the second micro-batch, behind the watermark."""
    early = F.col("timestamp") < F.lit(datetime(2024, 1, 20, 6, tzinfo=timezone.utc))
    return _deliver(spark, sf_dir, [~early, early], lateness="1 hour", **options)


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations and days that wait for a replay, with their late events."""
    return late_days(spark, _late(spark, sf_dir, snapshots=False))


def stream_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every micro-batch received, rejected and found late, and how far the stream had come."""
    rows = batch_log(spark, _late(spark, sf_dir, snapshots=False))
    return flat(
        rows, "batch_id", "received", "processed", "errors", "late", "last_event_at", "newest_event_at", "watermark"
    )


def stream_late_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics after the days of late events were run."""
    tables = _late(spark, sf_dir)
    replay_late(spark, tables, HOURLY)
    return _stream_day_metrics(read_snapshots(spark, tables.snapshots))


QUERIES: dict[str, Query] = {
    "read_window": read_window,
    "contract_check": contract_check,
    "contract_json": contract_json,
    "contract_evolution": contract_evolution,
    "range_nulling": range_nulling,
    "oor_counts": oor_counts,
    "anomaly_rows": anomaly_rows,
    "missing_raw": missing_raw,
    "missing_resampled": missing_resampled,
    "missing_by_device": missing_devices,
    "typical_range": typical_range,
    "drop_missing": missing_dropped,
    "fill_constant": missing_filled,
    "ffill": _repaired(forward_fill, "auto"),
    "ffill_sliced": _repaired(forward_fill, "1d"),
    "interpolate": _repaired(interpolate, "auto"),
    "interpolate_sliced": _repaired(interpolate, "1d"),
    "interpolate_by_time": _repaired(interpolate, "1d", by="time"),
    "resample_5m": _resampled("5min"),
    "resample_1h": _resampled("1h"),
    "resample_1w": _resampled("1w"),
    "resample_1mo": _resampled("1mo"),
    "resample_grid": resample_grid,
    "flatline_count": flatline_count,
    "flatline_periods": flatline_list,
    "flatline_periods_sliced": flatline_list_sliced,
    "gaps": gaps,
    "gaps_sliced": gaps_sliced,
    "faults": faults_power_without_flow,
    "faults_zero_flow": faults_zero_flow,
    "uptime": _metrics("uptime_seconds"),
    "cycles": _metrics("cycle_count"),
    "flow_volume": _metrics("total_flow_volume_m3"),
    "pressure_stats": _metrics(
        "average_pressure_bar", "peak_pressure_bar", "pressure_std_bar", "reading_count"
    ),
    "specific_power": _metrics("specific_power_kw_per_m3h"),
    "thermal": _metrics("thermal_efficiency_temp_per_kw"),
    "station_window": window_of_station,
    "device_metrics": _run_devices("interpolate", "auto"),
    "device_metrics_sliced": _run_devices("interpolate", "1d"),
    "device_metrics_1s": _run_devices("interpolate", "1d", rule="1s"),
    "device_metrics_1s_max_gap": _run_devices("ffill", "1d", rule="1s", max_gap_seconds=1800),
    "device_metrics_ffill": _run_devices("ffill", "1d"),
    "device_metrics_drop": _run_devices("drop", "auto"),
    "device_metrics_thresholds": _run_devices(
        "interpolate", "auto", motor_on_threshold_rpm=3200.0, power_on_threshold_kw=60.0, flow_epsilon_m3h=90.0
    ),
    "device_metrics_max_gap": _run_devices("interpolate", "auto", max_gap_seconds=3600),
    "metrics_long": long_metrics,
    "trend": trend,
    "trend_daily": daily_trend,
    "clean_readings": clean_readings,
    "dq_score": dq_score,
    "dq_report": _report("auto"),
    "dq_report_sliced": _report("1d"),
    "station_results": station_results,
    "busiest_slice": busiest,
    "busiest_run": busiest_run,
    "process_receipts": process_receipts,
    "snapshot_upsert": snapshot_upsert,
    "snapshot_overlap": snapshot_overlap,
    "snapshot_device": snapshot_device,
    "incremental_lookback": _lookback("interpolate"),
    "incremental_lookback_ffill": _lookback("ffill"),
    "incremental_pending": incremental_pending,
    "incremental_corrected": incremental_corrected,
    "rollup_1d": _rolled_up("1d"),
    "rollup_1w": _rolled_up("1w"),
    "rollup_1mo": _rolled_up("1mo"),
    "rollup_window": rollup_window,
    "rollup_corrected": rollup_corrected,
    "incremental_reverted": incremental_reverted,
    "incremental_files": incremental_files,
    "null_rows_whole": null_rows_whole,
    "null_rows_sliced": null_rows_sliced,
    "dq_report_nulls": dq_report_nulls,
    "snapshot_late_version": snapshot_late_version,
    "read_json_aliases": read_json_aliases,
    "empty_station": empty_station,
    "enriched": enriched,
    "stream_dead_letter": stream_dead_letter,
    "stream_dedupe": stream_dedupe,
    "stream_windows": stream_windows,
    "stream_long": stream_long,
    "stream_status": stream_status,
    "stream_snapshots": stream_snapshots,
    "stream_replay": stream_replay,
    "stream_lookback": stream_lookback,
    "stream_compacted": stream_compacted,
    "stream_late": stream_late,
    "stream_batch_log": stream_batch_log,
    "stream_late_replay": stream_late_replay,
}
