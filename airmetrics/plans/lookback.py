"""Incremental runs whose days add up to one run over the whole history.

Repair and metrics do not stop at midnight: a gap is filled from the last known value before it and,
when interpolated, towards the next one after it; uptime, switches and volume run across. So two
small tables are kept besides the ledger, one row per device and day each: the *edges* of the raw day
(its first and last known value of every sensor, and where they stand), and the *summary* of its
repaired buckets. Windows over the edges give every day what it gets from the days around it. A day
is run again when its rows changed, or when what it gets did; both are found without reading the
other days. Summaries combine over any range of days (see :mod:`airmetrics.operators.segments`).

Every table is written under its run, and a run counts once it is marked done, so a run that dies
half-way, or is repeated under its own name, changes nothing. Rows without station, device or time
are left out. The day is the unit of work: one device's day has to fit into a task's sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airmetrics.config import MissingData, PipelineConfig
from airmetrics.contract import SERIES, Contract
from airmetrics.functions.time import DAY, HOUR, bound_literal, parse_rule, time_bucket
from airmetrics.operators.impute import impute
from airmetrics.operators.segments import SUMS, combine, combine_all, metrics_of, segment_width, summaries
from airmetrics.operators.series import POS, SLICE, Layout, in_series, series_columns
from airmetrics.plans.incremental import LEDGER, PERIODS, STATE, pending_days, pending_range, read_ledger, with_period
from airmetrics.sources.folders import path_exists

DAYS = Layout(SERIES, DAY)
DAY_KEYS = (*SERIES, "period")
POINT = "struct<at:bigint,value:double>"
SUMMARY = ("first", "last", *SUMS, "pressure_max")


def process_with_lookback(
    spark: SparkSession,
    readings: DataFrame,
    path: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """Run all days that changed, and those that get other values from them; returns the days run."""
    return update(spark, readings, path, contract, config, pending_days(readings, read_ledger(spark, path)))


def update(
    spark: SparkSession,
    readings: DataFrame | Callable[[list[date]], DataFrame],
    path: str,
    contract: Contract,
    config: PipelineConfig,
    pending: DataFrame,
    run_id: str | None = None,
    held: DataFrame | None = None,
) -> DataFrame:
    """Run the pending ``(station_id, period)`` with look-back and look-ahead.

    ``pending`` has the columns of :func:`pending_days`. ``readings`` may be a function that reads
    the days it is given, for sources that are laid out by day. ``held`` are the rows of the pending days
    where the caller has them at hand; then only days that get other values are read. A run under the same
    ``run_id`` replaces what an earlier one of that name left.
    """
    rule = parse_rule(config.resample_rule)
    if not DAYS.nests(rule) or config.fill_grid:
        raise ValueError(f"days are run one by one: buckets of {config.resample_rule!r} must divide a day, without a grid")
    run_id = run_id or uuid4().hex
    ledger = read_ledger(spark, path, without=run_id)
    pending = _kept(pending.select(*PERIODS, *STATE), f"{path}/pending", run_id)
    sensors = contract.sensors

    # Edges of the changed days, and with them what every day gets now.
    own = _touched(readings, pending) if held is None else held.filter(in_series(SERIES))
    rows = _checked(own, contract)
    new = _kept(_edges(rows, sensors), f"{path}/edges", run_id)
    stored = _current(spark, path, ledger, sensors)
    others = stored.join(pending, on=list(PERIODS), how="left_anti")
    edges = others.select(*DAY_KEYS, "rows", *sensors).unionByName(new)
    gets = _carries(edges, sensors, config)

    # A day that gets other values than at its last run is run again.
    was = others.select(*DAY_KEYS, *[F.col(f"gets_{s}").alias(f"got_{s}") for s in sensors])
    same = F.lit(True)
    for s in sensors:
        same = same & F.col(f"gets_{s}").eqNullSafe(F.col(f"got_{s}"))
    moved = gets.join(was, on=list(DAY_KEYS)).filter(~same).select(*PERIODS).distinct()
    moved = ledger.join(moved, on=list(PERIODS), how="left_semi").select(*PERIODS, *STATE)
    planned = _kept(pending.unionByName(moved), f"{path}/planned", run_id, LEDGER)

    if held is None:
        rows = _checked(_touched(readings, planned), contract)
    else:
        others = planned.join(pending, on=list(PERIODS), how="left_anti")
        rows = rows.unionByName(_checked(_touched(readings, others), contract))
    summary = _summaries(rows, gets, contract, config)
    here = edges.join(planned.select(*PERIODS), on=list(PERIODS), how="left_semi")
    days = here.join(gets.drop("rows"), on=list(DAY_KEYS)).join(summary, on=list(DAY_KEYS), how="left")
    _kept(days, f"{path}/days", run_id)
    marker = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("finished_at"))
    marker.write.mode("append").parquet(f"{path}/done")
    return planned.select(*PERIODS, "rows")


def totals(
    spark: SparkSession,
    path: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Metrics per device over the stored days from ``start`` to ``end``, no reading touched.

    Over all days they are those of one run over all readings.
    """
    days = _current(spark, path, read_ledger(spark, path), contract.sensors)
    lo, hi = bound_literal(start), bound_literal(end)
    if lo is not None:
        days = days.filter(F.col("period") >= F.to_date(lo))
    if hi is not None:
        days = days.filter(F.col("period") <= F.to_date(hi))
    whole = combine_all(days.select(*SERIES, *SUMMARY), SERIES, config, DAY)
    return metrics_of(whole, SERIES).filter("reading_count > 0")


def repaired_days(
    spark: SparkSession, readings: DataFrame, path: str, contract: Contract, config: PipelineConfig = PipelineConfig()
) -> DataFrame:
    """Readings of the stored days, repaired with what the days get; reads only the rows given."""
    days = _current(spark, path, read_ledger(spark, path), contract.sensors)
    return _repaired(_checked(readings.filter(in_series(SERIES)), contract), days, contract, config)


# -- tables --------------------------------------------------------------------------------


def _kept(rows: DataFrame, path: str, run_id: str, schema: str | None = None) -> DataFrame:
    """Write one run's rows, in place of any it has written before, and read them back."""
    spark = rows.sparkSession
    writer = rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    ddl = schema or f"{rows.schema.toDDL()}, run_id string"
    kept = spark.read.schema(ddl).parquet(path).filter(F.col("run_id") == run_id)
    return kept.select(*rows.columns)


def _current(spark: SparkSession, path: str, ledger: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Each day as its newest finished run left it."""
    schema = ", ".join(
        ["station_id string, device_id string, period date, rows bigint"]
        + [f"`{s}` struct<first:struct<pos:bigint,{POINT[7:-1]}>,last:struct<pos:bigint,{POINT[7:-1]}>>" for s in sensors]
        + [f"`gets_{s}` struct<prev:{POINT},next:{POINT}>" for s in sensors]
        + _summary_ddl()
        + ["run_id string"]
    )
    if not path_exists(spark, f"{path}/days"):
        return spark.createDataFrame([], schema).drop("run_id")
    days = spark.read.schema(schema).parquet(f"{path}/days")
    return days.join(ledger.select(*PERIODS, "run_id"), on=[*PERIODS, "run_id"]).drop("run_id")


def _summary_ddl() -> list[str]:
    edge = "struct<timestamp:timestamp,tie:bigint,on:boolean,flow:double>"
    whole = {"uptime", "switches", "readings", "pressure_n", "ratio_n", "temp_n", "power_n"}
    kinds = {"first": edge, "last": edge} | {c: "bigint" if c in whole else "double" for c in (*SUMS, "pressure_max")}
    return [f"`{c}` {kinds[c]}" for c in SUMMARY]


def _touched(readings: DataFrame | Callable[[list[date]], DataFrame], days: DataFrame) -> DataFrame:
    """Rows of these days; the scan is cut to their range."""
    if callable(readings):
        # Calendar days, not rows.
        readings = readings([r.period for r in days.select("period").distinct().collect()])
    rows = with_period(pending_range(readings.filter(in_series(SERIES)), days))
    return rows.join(days.select(*PERIODS), on=list(PERIODS), how="left_semi").drop("period")


def _checked(rows: DataFrame, contract: Contract) -> DataFrame:
    used = series_columns(rows, DAYS, contract.sensors)
    return rows.select(*used).withColumns({s: contract.in_range(s) for s in contract.sensors})


def _period() -> Column:
    return F.to_date(F.timestamp_micros(SLICE))


# -- edges ---------------------------------------------------------------------------------


def _edges(rows: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Per device and day: its rows, and first and last known value of every sensor."""
    placed = DAYS.spread(rows)
    placed = placed.withColumn(POS, F.row_number().over(DAYS.forward()).cast("long"))

    def known(s: str, pick: str) -> Column:
        point = f"named_struct('pos', {POS}, 'at', unix_micros(timestamp), 'value', `{s}`)"
        return F.expr(f"{pick}(CASE WHEN `{s}` IS NOT NULL THEN {point} END)")

    ends = [F.struct(known(s, "min").alias("first"), known(s, "max").alias("last")).alias(s) for s in sensors]
    days = placed.groupBy(*DAYS.partition).agg(F.count(F.lit(1)).alias("rows"), *ends)
    return days.select(*SERIES, _period().alias("period"), "rows", *sensors)


def _carries(edges: DataFrame, sensors: Sequence[str], config: PipelineConfig) -> DataFrame:
    """What each day gets per sensor: the nearest known point before it and after it.

    Only what the day can use: nothing for a sensor that is known at that end of the day, and no
    point after it where the strategy does not look ahead. Places are counted from the day's first
    row (or are times), so days elsewhere do not move them.
    """
    order = Window.partitionBy(*SERIES).orderBy("period")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*SERIES).orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, -1)
    by_row = config.interpolate_by == "row"
    looks_back = config.strategy in (MissingData.FFILL, MissingData.INTERPOLATE)
    looks_ahead = config.strategy is MissingData.INTERPOLATE
    rows = edges.withColumn("_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))

    def point(s: str, end: str, window, used: bool) -> Column:
        at = f"`{s}`.{end}.pos + _before" if by_row else f"`{s}`.{end}.at"
        here = F.expr(f"CASE WHEN `{s}`.{end} IS NOT NULL THEN named_struct('at', {at}, 'value', `{s}`.{end}.value) END")
        return F.last(here, ignorenulls=True).over(window) if used else F.lit(None)

    found = {f"_{side}_{s}": point(s, end, window, used).cast(POINT) for s in sensors for side, end, window, used in
             (("prev", "last", before, looks_back), ("next", "first", after, looks_ahead))}
    rows = rows.withColumns(found)
    shift = "_before" if by_row else "0L"
    if config.strategy is MissingData.FFILL:
        shift = "NULL"  # only the value counts

    def got(s: str, side: str, end: str, edge: str) -> Column:
        moved = f"named_struct('at', _{side}_{s}.at - {shift}, 'value', _{side}_{s}.value)"
        open_end = f"coalesce(`{s}`.{end}.pos <> {edge}, true)"
        return F.expr(f"CASE WHEN {open_end} AND _{side}_{s} IS NOT NULL THEN {moved} END").cast(POINT).alias(side)

    gets = [F.struct(got(s, "prev", "first", "1"), got(s, "next", "last", "rows")).alias(f"gets_{s}") for s in sensors]
    return rows.select(*DAY_KEYS, "rows", *gets)


def _repaired(rows: DataFrame, gets: DataFrame, contract: Contract, config: PipelineConfig) -> DataFrame:
    """Rows of days, repaired by the strategy with what the days get from outside."""
    start = (F.unix_micros(F.col("period").cast("timestamp"))).alias(SLICE)
    if config.strategy is MissingData.FFILL:
        edges = gets.select(*SERIES, start, *[F.col(f"gets_{s}.prev.value").alias(f"_carried_{s}") for s in contract.sensors])
    else:
        sides = [F.col(f"gets_{s}.{side}").alias(f"_carried_{side}_{s}") for s in contract.sensors for side in ("prev", "next")]
        edges = gets.select(*SERIES, start, F.lit(0).cast("long").alias("_before"), *sides)
    placed = DAYS.spread(rows)
    return impute(placed, config.strategy, contract.sensors, DAYS, config.fill_values, config.interpolate_by, edges)


def _summaries(rows: DataFrame, gets: DataFrame, contract: Contract, config: PipelineConfig) -> DataFrame:
    """One summary per device and day."""
    rule = parse_rule(config.resample_rule)
    clean = _repaired(rows, gets, contract, config)
    buckets = clean.groupBy(*DAYS.partition, time_bucket("timestamp", rule).alias("_bucket")).agg(
        *[F.avg(s).alias(s) for s in contract.sensors]
    )
    buckets = buckets.drop(SLICE).withColumnRenamed("_bucket", "timestamp")
    layout = Layout(SERIES, segment_width(rule))
    parts = summaries(buckets, config, layout).withColumn("period", _period())
    if layout.slice_us < HOUR:
        hour = F.floor(F.col(SLICE) / HOUR).alias("_hour")
        parts = combine(parts.withColumn("_hour", hour), [*DAY_KEYS, "_hour"], config)
    if layout.slice_us < DAY:
        parts = combine(parts, DAY_KEYS, config)
    return parts.select(*DAY_KEYS, *SUMMARY)
