"""Stored rollups: levels of partial sums, kept up to date by day.

Every level is built from the one below, so the readings are read once, and only those of days that
changed. A read takes the widest stored level that tiles the asked buckets and has an edge at both ends
of the asked range; years of daily or weekly values then cost one row per device and day.

Rows lie under the day and the run that wrote them. A run counts once it is marked done, and of each
station's day the newest finished run is read, so a run that dies half-way changes nothing and a repeated
one only replaces. Rows without station or time are left out; values out of range count as unknown.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.contract import SERIES, Contract
from airmetrics.functions.time import parse_bound, parse_rule
from airmetrics.operators.ranges import null_out_of_range
from airmetrics.operators.rollups import ROWS, coarser, on_edge, partials, tiles
from airmetrics.plans.incremental import LEDGER, PERIODS, pending_days, pending_range, read_ledger, with_period
from airmetrics.sources.folders import child_folders, delete_folders, path_exists

LEVELS = ("5min", "1h", "1d")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def update_rollups(
    spark: SparkSession, readings: DataFrame, path: str, contract: Contract, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Bring all levels up to date with ``readings``; returns the days that were done.

    ``levels`` go from narrow to wide, each tiling the next and the last one tiling a day. A table keeps
    the levels it was made with.
    """
    for fine, coarse in zip(levels, [*levels[1:], "1d"]):
        if not tiles(fine, coarse):
            raise ValueError(f"buckets of {fine!r} do not tile those of {coarse!r}")
    if path_exists(spark, f"{path}/levels") and set(stored_levels(spark, path)) != set(levels):
        raise ValueError(f"the table has the levels {stored_levels(spark, path)}")
    run_id = uuid4().hex
    pending = pending_days(readings, read_ledger(spark, path)).withColumn("run_id", F.lit(run_id))
    pending.write.mode("append").parquet(f"{path}/planned")
    planned = spark.read.schema(LEDGER).parquet(f"{path}/planned").filter(F.col("run_id") == run_id)
    touched = with_period(pending_range(readings, planned)).join(planned.select(*PERIODS), list(PERIODS), "left_semi")
    sensors, keys = contract.sensors, (*SERIES, "period")
    level = partials(null_out_of_range(touched, contract), levels[0], sensors, keys)
    for n, rule in enumerate(levels):
        if n:
            level = coarser(_level(spark, path, levels[n - 1], contract).filter(F.col("run_id") == run_id), rule, sensors, keys)
        rows = level.withColumn("run_id", F.lit(run_id)).hint("rebalance", "period")
        rows.write.mode("append").partitionBy("period", "run_id").parquet(f"{path}/levels/{_folder(rule)}")
    marker = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("finished_at"))
    marker.write.mode("append").parquet(f"{path}/done")
    return planned.select(*PERIODS, ROWS)


def read_rollups(
    spark: SparkSession,
    path: str,
    rule: str,
    contract: Contract,
    stations: Sequence[str] | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
) -> DataFrame:
    """Partials per series and bucket of ``rule``, over stored buckets from ``start`` up to before ``end``.

    Both bounds have to be edges of some stored level that tiles ``rule``; a bucket that a bound cuts holds
    what lies inside the range. Station, days and range reach the scan.
    """
    low, high = parse_bound(start), parse_bound(end)
    level = best_level(stored_levels(spark, path), rule, low, high)
    rows = _level(spark, path, level, contract)
    if stations is not None:
        rows = rows.filter(F.col("station_id").isin(list(stations)))
    if low is not None:
        rows = rows.filter((F.col("period") >= F.lit(_day(low))) & (F.col("timestamp") >= F.lit(low)))
    if high is not None:
        last = _day(high - timedelta(microseconds=1))
        rows = rows.filter((F.col("period") <= F.lit(last)) & (F.col("timestamp") < F.lit(high)))
    newest = read_ledger(spark, path).select(*PERIODS, "run_id")
    rows = rows.join(newest, [*PERIODS, "run_id"], "left_semi")
    return coarser(rows, rule, contract.sensors)


def best_level(levels: Sequence[str], rule: str, low: datetime | None = None, high: datetime | None = None) -> str:
    """The widest level that tiles ``rule`` and has an edge at each bound."""
    bounds = [(b - EPOCH) // timedelta(microseconds=1) for b in (low, high) if b is not None]
    usable = [v for v in levels if tiles(v, rule) and all(on_edge(us, v) for us in bounds)]
    if not usable:
        raise ValueError(f"no stored level of {sorted(levels)} gives buckets of {rule!r} between these bounds")
    return max(usable, key=lambda v: parse_rule(v).width_us)


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete the days of runs that no station's newest version comes from; returns how many folders.

    Unfinished runs go as well, so none may be under way; readers that planned before may fail and have to
    be repeated. Names of days and runs pass through the driver, no rows.
    """
    current = {(str(r.period), r.run_id) for r in read_ledger(spark, path).select("period", "run_id").distinct().collect()}
    old = [
        folder
        for level in stored_levels(spark, path)
        for day, under in child_folders(spark, f"{path}/levels/{_folder(level)}", "period")
        for run_id, folder in child_folders(spark, under, "run_id")
        if (day, run_id) not in current
    ]
    delete_folders(spark, old)
    return len(old)


def stored_levels(spark: SparkSession, path: str) -> list[str]:
    """The widths stored, as their rules."""
    return [name for name, _ in child_folders(spark, f"{path}/levels", "rule")]


def _folder(rule: str) -> str:
    return f"rule={rule}"


def _level(spark: SparkSession, path: str, rule: str, contract: Contract) -> DataFrame:
    text = ", ".join(f"{k} string" for k in SERIES)
    parts = ", ".join(f"{s}_n bigint, {s}_sum double, {s}_min double, {s}_max double" for s in contract.sensors)
    schema = f"{text}, timestamp timestamp, {ROWS} bigint, {parts}, period date, run_id string"
    return spark.read.schema(schema).parquet(f"{path}/levels/{_folder(rule)}")


def _day(at: datetime):
    return at.astimezone(timezone.utc).date()
