"""Resampling onto fixed time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.contract import SERIES
from airmetrics.functions.time import Rule, parse_rule, time_bucket


def resample(
    df: DataFrame, rule: str | Rule, sensors: Sequence[str], keys: Sequence[str] = SERIES
) -> DataFrame:
    """Mean of each sensor per series and tumbling bucket, labelled by the bucket start.

    Means ignore NULL, empty buckets are not emitted. Partial means are combined before the
    shuffle, so a busy bucket costs no more than a quiet one.
    """
    return (
        df.filter(F.col("timestamp").isNotNull())
        .groupBy(*keys, time_bucket("timestamp", rule).alias("timestamp"))
        .agg(*[F.avg(s).alias(s) for s in sensors])
    )


# Missing buckets that one array holds on their way to becoming rows.
GRID_STEP = 4096


def fill_grid(df: DataFrame, rule: str | Rule, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add the empty buckets between a series' first and last one, with NULL sensors.

    Each row stands for itself and for the empty buckets up to the next row, so there is no join.
    Long silences are unfolded in two steps: a single stray old timestamp costs the rows it asks
    for, never one array of that length.
    """
    r = parse_rule(rule)
    series = Window.partitionBy(*keys).orderBy("timestamp")
    rows = df.withColumn("_next", F.lead("timestamp").over(series))
    if r.months:
        ahead = F.sequence("timestamp", "_next", F.make_interval(months=F.lit(r.months)))
        ahead = F.filter(ahead, lambda t: t < F.col("_next"))
        rows = rows.withColumn("_at", F.explode(F.coalesce(ahead, F.array("timestamp"))))
    else:
        at = F.unix_micros("timestamp")
        steps = F.coalesce(F.greatest(F.expr(f"(unix_micros(_next) - unix_micros(timestamp)) div {r.width_us}"), F.lit(1)), F.lit(1))
        rows = rows.withColumn("_steps", steps)
        rows = rows.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_steps - 1) div {GRID_STEP})")))
        within = f"sequence(_part * {GRID_STEP}, least((_part + 1) * {GRID_STEP}, _steps) - 1)"
        rows = rows.withColumn("_step", F.explode(F.expr(within)))
        rows = rows.withColumn("_at", F.timestamp_micros(at + F.col("_step") * r.width_us))
    own = F.col("_at") == F.col("timestamp")
    kept = {c: F.when(own, F.col(c)) for c in df.columns if c not in (*keys, "timestamp")}
    return rows.withColumns(kept).withColumn("timestamp", F.col("_at")).select(*df.columns)
