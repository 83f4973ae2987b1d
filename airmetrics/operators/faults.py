"""Faults that only show when two sensors are read together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.operators.flatlines import value_runs
from airmetrics.operators.metrics import FLOW, POWER, is_on_sql
from airmetrics.operators.series import Layout


def power_without_flow(df: DataFrame) -> DataFrame:
    """Readings that draw power while no air flows (no shuffle)."""
    return df.filter((F.col(POWER) > 0) & (F.col(FLOW) == 0))


def sustained_zero_flow(
    df: DataFrame,
    config: PipelineConfig = PipelineConfig(),
    minutes: int = 30,
    layout: Layout = Layout(),
) -> DataFrame:
    """Periods in which a running unit keeps delivering no air."""
    fault = f"CASE WHEN {is_on_sql(config)} AND {FLOW} = 0 THEN 1 END"
    name = "zero_flow_while_on"
    runs = value_runs(df, {name: fault}, {name: minutes}, layout)
    return runs.select(*layout.keys, F.col("sensor").alias("fault"), "start", "end", "minutes", "readings")
