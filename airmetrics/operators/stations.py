"""Station metadata next to what the readings show."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def device_counts(readings: DataFrame) -> DataFrame:
    """Devices seen per station. Both steps combine before their shuffle."""
    devices = readings.groupBy("station_id", "device_id").agg(F.count(F.lit(1)).alias("rows"))
    return devices.groupBy("station_id").agg(
        F.count("device_id").alias("devices_seen"), F.sum("rows").alias("rows")
    )


def check_device_counts(
    readings: DataFrame, stations: DataFrame, limits: tuple[float, float] = (1, 10)
) -> DataFrame:
    """Stations with metadata and a check of the declared number of compressors.

    The readings are reduced to one row per station before the join, so the join is small on
    both sides and needs no hint.
    """
    joined = device_counts(readings).join(stations, on="station_id", how="full")
    seen = F.coalesce("devices_seen", F.lit(0))
    declared = F.col("num_compressors")
    return joined.select(
        "station_id",
        *[c for c in stations.columns if c != "station_id"],
        seen.alias("devices_seen"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce(declared.between(*limits), F.lit(False)).alias("declared_valid"),
        F.coalesce(declared == seen, F.lit(False)).alias("count_matches"),
    )


def busiest_slice(readings: DataFrame, hours: int = 6) -> DataFrame:
    """The station with most readings and its first hours: ``station_id, start, end``."""
    span = readings.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("last"),
    )
    end = F.least(F.col("start") + F.lit(timedelta(hours=hours)), F.col("last"))
    top = span.orderBy(F.desc("rows"), "station_id").limit(1)
    return top.select("station_id", "rows", "start", end.alias("end"))


def busiest_readings(readings: DataFrame, hours: int = 6) -> DataFrame:
    """Readings inside the busiest slice (the slice is one row, so it is broadcast)."""
    one = F.broadcast(busiest_slice(readings, hours).select("station_id", "start", "end"))
    return (
        readings.join(one, on="station_id")
        .filter(F.col("timestamp").between(F.col("start"), F.col("end")))
        .select(*readings.columns)
    )
