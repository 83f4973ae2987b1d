"""Partial sums per bucket, from which any wider bucket is put together without the readings.

A partial holds, per series and bucket, the number of readings and of each sensor how many values are
known, their sum, the smallest and the largest. Partials of neighbouring buckets add up, so a level of
narrow buckets serves all wider ones that it tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airmetrics.contract import SERIES
from airmetrics.functions.time import DAY, Rule, parse_rule, time_bucket

ROWS = "rows"


def partial_columns(sensors: Sequence[str]) -> list[str]:
    return [ROWS, *[f"{s}_{part}" for s in sensors for part in ("n", "sum", "min", "max")]]


def partials(df: DataFrame, rule: str | Rule, sensors: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """One partial per series and bucket; rows without a time are left out, empty buckets do not appear."""
    known: list[Column] = []
    for s in sensors:
        known += [
            F.count(s).alias(f"{s}_n"),
            F.sum(s).alias(f"{s}_sum"),
            F.min(s).alias(f"{s}_min"),
            F.max(s).alias(f"{s}_max"),
        ]
    buckets = df.filter(F.col("timestamp").isNotNull()).groupBy(*keys, time_bucket("timestamp", rule).alias("timestamp"))
    return buckets.agg(F.count(F.lit(1)).alias(ROWS), *known)


def coarser(df: DataFrame, rule: str | Rule, sensors: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Partials of wider buckets out of those of narrower ones; ``keys`` may also be fewer than before."""
    together = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    parts = [f(f"{s}_{part}").alias(f"{s}_{part}") for s in sensors for part, f in together.items()]
    return df.groupBy(*keys, time_bucket("timestamp", rule).alias("timestamp")).agg(F.sum(ROWS).alias(ROWS), *parts)


def means(df: DataFrame, sensors: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Partials as resampled readings: the mean of each sensor, NULL where none is known."""
    return df.select(*keys, "timestamp", *[F.try_divide(f"{s}_sum", f"{s}_n").alias(s) for s in sensors])


def tiles(fine: str | Rule, coarse: str | Rule) -> bool:
    """True when buckets of ``fine`` fill every bucket of ``coarse`` exactly."""
    fine, coarse = parse_rule(fine), parse_rule(coarse)
    if coarse.months:
        # Months begin at midnight; only widths that divide a day have an edge at every midnight.
        return coarse.months % fine.months == 0 if fine.months else fine.divides(DAY)
    if fine.months:
        return False
    return coarse.width_us % fine.width_us == 0 and (coarse.origin_us - fine.origin_us) % fine.width_us == 0


def on_edge(us: int, rule: str | Rule) -> bool:
    """True when a bucket of a fixed width begins at these microseconds since the epoch."""
    r = parse_rule(rule)
    return bool(r.width_us) and (us - r.origin_us) % r.width_us == 0
