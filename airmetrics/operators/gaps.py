"""Silences: intervals between readings well above a device's usual cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.functions.time import whole_seconds
from airmetrics.operators.series import Layout, series_columns, with_previous


def intervals(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Per reading: the reading before and the whole seconds since."""
    rows = with_previous(df.select(*series_columns(df, layout)), layout, {"timestamp": F.col("timestamp")})
    rows = rows.filter(F.col("prev_timestamp").isNotNull())
    return rows.withColumn("seconds", whole_seconds(F.col("prev_timestamp"), F.col("timestamp")))


def nominal_cadence(steps: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Median interval per device, exact: a histogram first, then a walk over its few rows."""
    keys = layout.keys
    counts = steps.groupBy(*keys, "seconds").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("seconds")
    up_to = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.select(*keys, "seconds", up_to.alias("up_to"), total.alias("total"))
    at_least_half = F.col("up_to") * 2 >= F.col("total")
    return ranked.filter(at_least_half).groupBy(*keys).agg(F.min("seconds").alias("nominal_seconds"))


def reading_gaps(df: DataFrame, factor: float = 3.0, layout: Layout = Layout()) -> DataFrame:
    """Intervals longer than ``factor`` times the device's nominal cadence."""
    steps = intervals(df, layout)
    usual = nominal_cadence(steps, layout)
    return (
        steps.join(usual, on=list(layout.keys))
        .filter(F.col("seconds") > F.col("nominal_seconds") * factor)
        .select(
            *layout.keys,
            F.col("prev_timestamp").alias("gap_start"),
            F.col("timestamp").alias("gap_end"),
            "seconds",
            "nominal_seconds",
        )
    )
