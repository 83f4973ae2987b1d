"""Incremental runs: only the (station, day) pairs whose rows changed since the last run.

A day counts as changed when its number of rows or its content differs from what the newest
finished run saw, so corrected values and vanished rows are found too. Each day is run like a
request for that window: rows outside it do not take part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime, timedelta, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.contract import Contract
from airmetrics.plans.stations import run_pipeline
from airmetrics.sources.folders import path_exists
from airmetrics.sources.readings import time_range
from airmetrics.sources.snapshots import receipts, write_snapshots

STATE = ("rows", "content_high", "content_low")
LEDGER = "station_id string, period date, rows bigint, content_high bigint, content_low bigint, run_id string"
PERIODS = ("station_id", "period")


def with_period(readings: DataFrame) -> DataFrame:
    """Add the UTC day of each reading."""
    return readings.withColumn("period", F.to_date("timestamp"))


def day_states(readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per station and day, and a sum over their hashes that does not depend on order.

    ``by`` names further keys, which are not hashed; the states add up over them.
    """
    digest = F.xxhash64(*sorted(c for c in readings.columns if c not in by))
    return (
        with_period(readings)
        .withColumn("_digest", digest)
        .groupBy(*by, *PERIODS)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            # Halves of the hash: their sums cannot overflow.
            F.sum(F.shiftright("_digest", 32)).alias("content_high"),
            F.sum(F.col("_digest").bitwiseAND(0xFFFFFFFF)).alias("content_low"),
        )
    )


def read_ledger(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """What the newest finished run saw of each day; a run ``without`` is left out, as if it had not been."""
    if not path_exists(spark, f"{path}/done"):
        return spark.createDataFrame([], LEDGER)
    planned = spark.read.schema(LEDGER).parquet(f"{path}/planned")
    if without is not None:
        planned = planned.filter(F.col("run_id") != without)
    done = spark.read.schema("run_id string, finished_at timestamp").parquet(f"{path}/done")
    done = done.groupBy("run_id").agg(F.min("finished_at").alias("finished_at"))
    seen = F.max_by(F.struct(*STATE, "run_id"), F.struct("finished_at", "run_id")).alias("_seen")
    return planned.join(done, on="run_id").groupBy(*PERIODS).agg(seen).select(*PERIODS, "_seen.*")


def pending_days(readings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Days that are new or differ from what was last run; days without rows by now have 0."""
    now = day_states(readings).filter(F.col("station_id").isNotNull() & F.col("period").isNotNull())
    return changed_days(now, ledger)


def changed_days(now: DataFrame, ledger: DataFrame) -> DataFrame:
    """Days whose state is not what the ledger says."""
    then = ledger.select(*PERIODS, *[F.col(c).alias(f"_{c}") for c in STATE])
    both = now.join(then, on=list(PERIODS), how="full")
    current = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in STATE]
    same = F.lit(True)
    for c in STATE:
        same = same & F.coalesce(c, F.lit(0)).eqNullSafe(F.col(f"_{c}"))
    return both.filter(~same).select(*PERIODS, *current)


def process_pending(
    spark: SparkSession,
    readings: DataFrame,
    path: str,
    ledger: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """Run every pending day, store its snapshots, and return their receipts.

    The plan is written first and counts only once the run is marked done, so a run that dies
    half-way is simply repeated. The scan is cut to the range of the pending days; a day whose
    rows are all gone is stored as an empty result.
    """
    pending = pending_days(readings, read_ledger(spark, ledger))
    return run_days(spark, readings, pending, path, ledger, contract, config)


def run_days(
    spark: SparkSession,
    readings: DataFrame | Callable[[Sequence[date]], DataFrame],
    pending: DataFrame,
    path: str,
    ledger: str,
    contract: Contract,
    config: PipelineConfig,
) -> DataFrame:
    """Run the days of ``pending``; ``readings`` may be a function that reads the days it is given."""
    run_id, started = uuid4().hex, datetime.now(timezone.utc)
    pending = pending.withColumn("run_id", F.lit(run_id))
    pending.write.mode("append").parquet(f"{ledger}/planned")
    planned = spark.read.schema(LEDGER).parquet(f"{ledger}/planned").filter(F.col("run_id") == run_id)
    days = planned.select(*PERIODS)
    if callable(readings):
        # Calendar days, not rows.
        readings = readings([r.period for r in days.select("period").distinct().collect()])
    touched = with_period(pending_range(readings, planned)).join(days, on=list(PERIODS), how="left_semi")
    results = run_pipeline(touched, contract, config, by=PERIODS).results_for(days)
    write_snapshots(results, path, batch_id=run_id)
    marker = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("finished_at"))
    marker.write.mode("append").parquet(f"{ledger}/done")
    return receipts(spark, path, run_id, started)


def pending_range(readings: DataFrame, planned: DataFrame) -> DataFrame:
    """The readings from the first to the last pending day, as a filter that reaches the scan."""
    first, last = planned.agg(F.min("period"), F.max("period")).first()
    if first is None:
        return readings.limit(0)
    begin = datetime(first.year, first.month, first.day, tzinfo=timezone.utc)
    end = datetime(last.year, last.month, last.day, tzinfo=timezone.utc) + timedelta(days=1, microseconds=-1)
    return time_range(readings, begin, end)
