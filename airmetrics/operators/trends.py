"""Daily uptime and pressure against target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.contract import SERIES, Contract
from airmetrics.functions.time import whole_seconds
from airmetrics.operators.metrics import POWER, PRESSURE, SPEED, is_on, on_seconds
from airmetrics.operators.series import Layout, series_columns, with_previous


def daily_health(
    df: DataFrame,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
    layout: Layout = Layout(),
) -> DataFrame:
    """Per device and day: uptime share of the observed time, and pressure against target.

    An interval belongs to the day in which it ends. The target is the middle of the typical
    pressure range.
    """
    lo, hi = contract.typical_ranges[PRESSURE]
    target = (lo + hi) / 2
    used = series_columns(df, layout, (PRESSURE, POWER, SPEED))
    before = {"timestamp": F.col("timestamp"), "on": is_on(config)}
    rows = with_previous(df.select(*used), layout, before)
    seconds = whole_seconds(F.col("prev_timestamp"), F.col("timestamp"))
    daily = rows.groupBy(*layout.keys, F.to_date("timestamp").alias("day")).agg(
        F.coalesce(F.sum(on_seconds(config)), F.lit(0)).alias("uptime_seconds"),
        F.coalesce(F.sum(seconds), F.lit(0)).alias("observed_seconds"),
        F.avg(PRESSURE).alias("average_pressure_bar"),
    )
    return daily.withColumns(
        {
            "uptime_share": F.try_divide(F.col("uptime_seconds").cast("double"), F.col("observed_seconds")),
            "pressure_vs_target": F.col("average_pressure_bar") / target - 1.0,
        }
    )


def pressure_trend(daily: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Least-squares slope of daily mean pressure, in bar per day."""
    day = F.unix_date("day").cast("double")
    return daily.groupBy(*keys).agg(
        F.count("average_pressure_bar").alias("days"),
        F.try_divide(F.sum("uptime_seconds").cast("double"), F.sum("observed_seconds")).alias("uptime_share"),
        F.avg("pressure_vs_target").alias("pressure_vs_target"),
        F.regr_slope("average_pressure_bar", day).alias("pressure_slope_per_day"),
    )
