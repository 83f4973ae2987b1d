"""Operating metrics per device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.contract import SERIES
from airmetrics.functions.time import SECOND
from airmetrics.operators.quality import unpivot
from airmetrics.operators.series import Layout, series_columns, with_previous

PRESSURE = "discharge_pressure"
FLOW = "air_flow_rate"
POWER = "power_consumption"
SPEED = "motor_speed"
TEMPERATURE = "discharge_temp"

# Metric names of the stored documents.
METRICS = (
    "uptime_seconds",
    "average_pressure_bar",
    "peak_pressure_bar",
    "specific_power_kw_per_m3h",
    "cycle_count",
    "total_flow_volume_m3",
    "thermal_efficiency_temp_per_kw",
    "reading_count",
    "pressure_std_bar",
)


def is_on_sql(config: PipelineConfig) -> str:
    """A unit runs when its motor turns or it draws power."""
    return (
        f"(coalesce({SPEED}, 0D) > {float(config.motor_on_threshold_rpm)}D"
        f" OR coalesce({POWER}, 0D) > {float(config.power_on_threshold_kw)}D)"
    )


def is_on(config: PipelineConfig) -> Column:
    return F.expr(is_on_sql(config))


def previous_values(config: PipelineConfig) -> dict[str, Column]:
    """What a sample needs to know about the sample before it."""
    return {"timestamp": F.col("timestamp"), "on": is_on(config), "flow": F.col(FLOW)}


def _elapsed_sql(config: PipelineConfig) -> str:
    """Whole seconds since the sample before, NULL on the first one or after too long a silence."""
    seconds = f"(unix_micros(timestamp) - unix_micros(prev_timestamp)) div {SECOND}"
    if config.max_gap_seconds is None:
        return f"({seconds})"
    return f"(CASE WHEN {seconds} <= {int(config.max_gap_seconds)} THEN {seconds} END)"


def on_seconds(config: PipelineConfig) -> Column:
    """Elapsed seconds when this and the previous sample are both on."""
    return F.expr(f"CASE WHEN {is_on_sql(config)} AND prev_on THEN {_elapsed_sql(config)} END")


def metric_aggregates(config: PipelineConfig, counted: str = "true") -> dict[str, Column]:
    """The nine metrics over rows that carry ``prev_*`` columns (see :func:`previous_values`).

    A metric without usable samples is NULL. ``counted`` selects the rows that are readings.
    """
    on, elapsed = is_on_sql(config), _elapsed_sql(config)
    powered = f"CASE WHEN {POWER} > {float(config.power_on_threshold_kw)}D THEN"
    # Only where the flow is meaningful, and only finite ratios.
    ratio = (
        f"CASE WHEN abs({FLOW}) > {float(config.flow_epsilon_m3h)!r}D THEN try_divide({POWER}, {FLOW}) END"
    )
    finite = f"CASE WHEN NOT isnan({ratio}) AND abs({ratio}) < double('Infinity') THEN {ratio} END"
    texts = {
        "uptime_seconds": f"coalesce(sum(CASE WHEN {on} AND prev_on THEN {elapsed} END), 0)",
        "average_pressure_bar": f"avg({PRESSURE})",
        "peak_pressure_bar": f"max({PRESSURE})",
        "specific_power_kw_per_m3h": f"avg({finite})",
        # Off-to-on edges; a series that begins on has its first cycle there.
        "cycle_count": f"count(CASE WHEN {on} AND NOT coalesce(prev_on, false) THEN 1 END)",
        # Trapezoids between neighbouring samples, in m3.
        "total_flow_volume_m3": f"coalesce(sum(({FLOW} + prev_flow) / 2 * ({elapsed} / 3600D)), 0D)",
        # A ratio of means over powered samples, not a mean of ratios.
        "thermal_efficiency_temp_per_kw": (
            f"try_divide(avg({powered} {TEMPERATURE} END), avg({powered} {POWER} END))"
        ),
        "reading_count": f"count(CASE WHEN {counted} THEN 1 END)",
        "pressure_std_bar": f"stddev_samp({PRESSURE})",
    }
    return {name: F.expr(text) for name, text in texts.items()}


def device_metrics(
    df: DataFrame,
    config: PipelineConfig = PipelineConfig(),
    layout: Layout = Layout(),
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """One row of metrics per device over cleaned, resampled readings."""
    used = series_columns(df, layout, (PRESSURE, FLOW, POWER, SPEED, TEMPERATURE))
    rows = with_previous(df.select(*used), layout, previous_values(config))
    metrics = metric_aggregates(config)
    return rows.groupBy(*(keys or layout.keys)).agg(*[c.alias(n) for n, c in metrics.items()])


def station_window(df: DataFrame, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """First and last bucket start per station, and the number of buckets."""
    return df.groupBy(*by).agg(
        F.min("timestamp").alias("window_start"),
        F.max("timestamp").alias("window_end"),
        F.count(F.lit(1)).alias("rows_processed"),
    )


def metrics_long(
    metrics: DataFrame,
    keys: Sequence[str] = SERIES,
    stations: Sequence[str] | None = None,
    devices: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Device metrics as ``(keys, metric, value)``, optionally narrowed by any of them.

    Station and device filters come before the aggregation when ``metrics`` is still a plan;
    unwanted metrics are never computed.
    """
    wanted = tuple(METRICS if names is None else names)
    if unknown := set(wanted) - set(METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    if stations is not None:
        metrics = metrics.filter(F.col("station_id").isin(list(stations)))
    if devices is not None:
        metrics = metrics.filter(F.col("device_id").isin(list(devices)))
    doubles = metrics.select(*keys, *[F.col(m).cast("double").alias(m) for m in wanted])
    return unpivot(doubles, list(keys), wanted, "metric", "value")
