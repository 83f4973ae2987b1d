"""Stateful stream operators: duplicates, late data and tumbling windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.contract import SERIES, Contract
from airmetrics.functions.time import parse_rule
from airmetrics.operators.quality import count_if

SALTS = 16


def dedupe_stream(events: DataFrame, delay: str = "10 minutes", salts: int = SALTS) -> DataFrame:
    """One row per ``event_id`` within the watermark.

    Copies of one event may be a large part of a stream. They are first spread over ``salts``
    keys by the source partition they came from, so no single task sees them all; the second
    step then has at most ``salts`` copies per batch left to drop.
    """
    marked = events.withWatermark("timestamp", delay)
    if salts <= 1:
        return marked.dropDuplicatesWithinWatermark(["event_id"])
    salted = marked.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = salted.dropDuplicatesWithinWatermark(["event_id", "_salt"])
    return first.drop("_salt").dropDuplicatesWithinWatermark(["event_id"])


def window_aggregates(
    events: DataFrame,
    contract: Contract,
    rule: str = "5min",
    delay: str | None = "10 minutes",
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Bucket means and quality counts per device, emitted once the watermark closes a bucket.

    ``delay=None`` keeps the watermark that ``events`` already carry. Means are over valid
    values, as in a batch run before gap repair. Partial aggregates come before the shuffle, so
    a busy device does not slow its partition.
    """
    r = parse_rule(rule)
    if r.origin_us:
        bucket = F.window("timestamp", r.interval(), r.interval(), f"{r.origin_us} microseconds")
    else:
        bucket = F.window("timestamp", r.interval())
    sums = [F.avg(contract.in_range(s)).alias(s) for s in contract.sensors]
    bad = [count_if(contract.out_of_range(s)).alias(f"oor_{s}") for s in contract.sensors]
    missing = [F.avg(F.col(s).isNull().cast("double")).alias(f"missing_{s}") for s in contract.sensors]
    # Grouping by the whole window keeps the watermark; its start is taken afterwards.
    if delay is not None:
        events = events.withWatermark("timestamp", delay)
    grouped = events.groupBy(bucket, *keys).agg(
        F.count(F.lit(1)).alias("readings"),
        count_if(contract.any_out_of_range()).alias("anomaly_rows"),
        *sums,
        *bad,
        *missing,
    )
    values = [c for c in grouped.columns if c not in ("window", *keys)]
    return grouped.select(*keys, F.col("window.start").alias("timestamp"), *values)
