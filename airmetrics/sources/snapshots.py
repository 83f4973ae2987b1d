"""Snapshot table: results per station and window, appended, newest version wins on read."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.functions.time import bound_literal, parse_bound
from airmetrics.operators.metrics import METRICS
from airmetrics.sources.folders import delete_files, path_exists

# A result is replaced by a later one for the same station and slot. The slot is the window the
# data spans, or the period when results are kept per period (its span may grow with late data).
KEY = ("station_id", "slot")
WINDOW = ("station_id", "window_start", "window_end")
# A table is laid out by the months a slot begins and ends in. A slot never changes them, so all versions
# of a key lie together, and reads are cut at both ends.
MONTHS = ("window_month", "last_month")
EMPTY_MONTH = "empty"
#: How far the clocks of the file system and of the driver may differ.
CLOCK_SKEW = timedelta(hours=1)

_COUNTS = ("uptime_seconds", "cycle_count", "reading_count")
METRIC_VALUES = T.StructType(
    [T.StructField(m, T.LongType() if m in _COUNTS else T.DoubleType()) for m in METRICS]
)
DEVICE = T.StructType(
    [T.StructField("device_id", T.StringType()), T.StructField("metrics", METRIC_VALUES)]
)
_SHARES = T.MapType(T.StringType(), T.DoubleType())
QUALITY = T.StructType(
    [
        T.StructField("missing_fraction_by_column", _SHARES),
        T.StructField("out_of_range_count_by_column", T.MapType(T.StringType(), T.LongType())),
        T.StructField("flatline_periods_count", T.LongType()),
        T.StructField("rows_before_clean", T.LongType()),
        T.StructField("rows_after_clean", T.LongType()),
        T.StructField("anomaly_rows_pre_clean", T.LongType()),
        T.StructField(
            "extra",
            T.StructType(
                [
                    T.StructField("missing_fraction_before_clean", _SHARES),
                    T.StructField("flatline_periods_pre_clean_hint", T.LongType()),
                    T.StructField("resample_rule", T.StringType()),
                    T.StructField("missing_strategy", T.StringType()),
                    T.StructField("note", T.StringType()),
                ]
            ),
        ),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("station_id", T.StringType()),
        T.StructField("window_start", T.StringType()),
        T.StructField("window_end", T.StringType()),
        T.StructField("devices", T.ArrayType(DEVICE)),
        T.StructField(
            "extras",
            T.StructType(
                [
                    T.StructField("rows_processed", T.LongType()),
                    T.StructField("data_quality_score", T.DoubleType()),
                ]
            ),
        ),
    ]
)
SNAPSHOT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("window_start", T.StringType()),
        T.StructField("window_end", T.StringType()),
        T.StructField("window_start_ts", T.TimestampType()),
        T.StructField("window_end_ts", T.TimestampType()),
        T.StructField("computed_at", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("data_quality_score", T.DoubleType()),
        T.StructField("data_quality", QUALITY),
        T.StructField("metrics", RESULT),
        T.StructField("window_month", T.StringType()),
        T.StructField("last_month", T.StringType()),
    ]
)


def snapshot_rows(
    results: DataFrame, computed_at: datetime | None = None, batch_id: str | None = None
) -> DataFrame:
    """Station results as snapshot rows."""
    at = computed_at or datetime.now(timezone.utc)
    if "period" in results.columns:
        slot = F.concat(F.lit("period "), F.col("period").cast("string"))
        # The period never moves; the window of its rows may, and with it the newest version.
        month = last = F.date_format("period", "yyyy-MM")
    else:
        month, last = (F.date_format(f"window_{side}_ts", "yyyy-MM") for side in ("start", "end"))
        slot = F.concat_ws("/", "window_start", "window_end")
    rows = results.withColumn("slot", slot).withColumns(
        {
            "id": F.xxhash64(*KEY),
            "computed_at": F.lit(at),
            "batch_id": F.lit(batch_id or uuid4().hex),
            "window_month": F.coalesce(month, F.lit(EMPTY_MONTH)),
            "last_month": F.coalesce(last, F.lit(EMPTY_MONTH)),
        }
    )
    return rows.select(*SNAPSHOT.names)


def write_snapshots(
    results: DataFrame,
    path: str,
    computed_at: datetime | None = None,
    batch_id: str | None = None,
) -> str:
    """Append one version per (station, window) and return the batch id.

    Appending keeps the write free of reads and locks; :func:`read_snapshots` shows only the
    newest version of a key, so repeating a run replaces its result.
    """
    batch_id = batch_id or uuid4().hex
    rows = snapshot_rows(results, computed_at, batch_id)
    # Few files per month, and several when a month holds very many stations.
    rows.hint("rebalance", *MONTHS).write.mode("append").partitionBy(*MONTHS).parquet(path)
    return batch_id


def snapshot_versions(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """All stored versions; a table not yet written reads as empty.

    ``since`` leaves out files that were finished before it; they are listed, not opened.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], SNAPSHOT)
    reader = spark.read.schema(SNAPSHOT)
    if since is not None:
        after = f"{(since - CLOCK_SKEW).astimezone(timezone.utc):%Y-%m-%dT%H:%M:%S}"
        reader = reader.option("modifiedAfter", after).option("timeZone", "UTC")
    return reader.parquet(path)


def newest(versions: DataFrame) -> DataFrame:
    """Newest version per key, as an aggregate that combines before its shuffle."""
    rest = [c for c in versions.columns if c not in KEY]
    latest = F.max_by(F.struct(*rest), F.struct("computed_at", "batch_id")).alias("_v")
    return versions.groupBy(*KEY).agg(latest).select(*KEY, "_v.*").select(*versions.columns)


def overlapping(
    snapshots: DataFrame, start: str | datetime | None = None, end: str | datetime | None = None
) -> DataFrame:
    """Windows that touch ``[start, end]``; results without rows always match."""
    lo, hi = bound_literal(start), bound_literal(end)
    if lo is not None:
        snapshots = snapshots.filter(F.col("window_end_ts").isNull() | (F.col("window_end_ts") >= lo))
    if hi is not None:
        snapshots = snapshots.filter(F.col("window_start_ts").isNull() | (F.col("window_start_ts") <= hi))
    return snapshots


def only_device(snapshots: DataFrame, device_id: str) -> DataFrame:
    """Keep one device inside ``metrics.devices``; the snapshot row stays even when none is left."""
    devices = F.filter("metrics.devices", lambda d: d["device_id"] == device_id)
    return snapshots.withColumn("metrics", F.col("metrics").withField("devices", devices))


def read_snapshots(
    spark: SparkSession,
    path: str,
    station_id: str | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    device_id: str | None = None,
) -> DataFrame:
    """Current snapshots, newest first. The station filter and the months of the range reach the scan."""
    rows = snapshot_versions(spark, path)
    if station_id is not None:
        rows = rows.filter(F.col("station_id") == station_id)
    # A window or period that ends in an earlier month or begins in a later one cannot overlap, whichever
    # version is current: all versions of a key have the same months.
    if (since := parse_bound(start)) is not None:
        last = F.col("last_month")
        rows = rows.filter((last >= f"{since.astimezone(timezone.utc):%Y-%m}") | (last == EMPTY_MONTH))
    if (until := parse_bound(end)) is not None:
        month = F.col("window_month")
        rows = rows.filter((month <= f"{until.astimezone(timezone.utc):%Y-%m}") | (month == EMPTY_MONTH))
    rows = overlapping(newest(rows), start, end)
    if device_id is not None:
        rows = only_device(rows, device_id)
    return rows.orderBy(F.desc("computed_at"), *KEY)


def compact_snapshots(spark: SparkSession, path: str, months: list[str] | None = None) -> None:
    """Rewrite months (in which windows begin) so that only current versions remain; other months are not touched.

    The current versions are appended as new files, then the files that were read are deleted.
    A version that another run appends meanwhile lies in a file of its own and stays; until the
    end a version may be there twice, which the newest-version rule does not show.
    """
    versions = snapshot_versions(spark, path)
    if months is not None:
        versions = versions.filter(F.col("window_month").isin(months))
    # The names are those of the whole table, whatever the filter.
    ours = None if months is None else {f"window_month={m}" for m in months}
    read = [f for f in map(unquote, versions.inputFiles()) if ours is None or ours & set(f.split("/"))]
    current = newest(versions).hint("rebalance", *MONTHS)
    current.write.mode("append").partitionBy(*MONTHS).parquet(path)
    delete_files(spark, read)


def snapshot_metrics(
    snapshots: DataFrame, devices: list[str] | None = None, names: list[str] | None = None
) -> DataFrame:
    """Stored device metrics in long form: key, device, metric, value."""
    wanted = list(METRICS if names is None else names)
    d = F.col("d")
    rows = snapshots.select(*WINDOW, F.explode("metrics.devices").alias("d"))
    if devices is not None:
        rows = rows.filter(d["device_id"].isin(devices))
    wide = rows.select(
        *WINDOW, d["device_id"].alias("device_id"), *[d["metrics"][m].cast("double").alias(m) for m in wanted]
    )
    return wide.unpivot([*WINDOW, "device_id"], wanted, "metric", "value")


def receipts(spark: SparkSession, path: str, batch_id: str, since: datetime | None = None) -> DataFrame:
    """What one run stored, one row per station and window; files older than ``since`` are not opened."""
    rows = snapshot_versions(spark, path, since).filter(F.col("batch_id") == batch_id)
    return rows.select(
        "station_id", F.col("id").alias("snapshot_id"), "window_start", "window_end", "data_quality_score"
    )
