"""Sensor events: parsing, dead letters, and the way from events to readings.

These functions work on batch and streaming frames alike; the transport only has to deliver a
string column with one JSON event per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.contract import Contract
from airmetrics.operators.quality import unpivot

# Event envelope, and the reasons an event is set aside.
SENSOR_READING = "sensor_reading"
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        # Values stay text here: a typed struct would silently null a bad value's neighbours.
        T.StructField("readings", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
CORRUPT, MISSING_FIELD, BAD_TYPE = "corrupt", "missing_field", "bad_type"


def json_files_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Newline-delimited JSON files as a raw stream."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(F.col("value").alias("raw"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A Kafka topic as a raw stream (needs Spark's Kafka connector on the class path)."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, **options}
    stream = spark.readStream.format("kafka").options(**options).load()
    return stream.select(F.col("value").cast("string").alias("raw"))


def parse_events(raw: DataFrame, contract: Contract, keep: Sequence[str] = ()) -> DataFrame:
    """Envelope fields, one double per sensor, and ``reason`` (NULL when the event is good).

    ``keep`` names further columns of the input to pass through.
    """
    e = F.col("_e")
    # A generator keeps filters on the result from being pushed into the parse, where every
    # mention of a field would parse the text again.
    once = F.explode(F.array(F.from_json("raw", ENVELOPE))).alias("_e")
    parsed = raw.select("raw", *keep, once)
    # Each step uses what the one before has made: no text is looked up or converted twice.
    texts = {f"_text_{s}": e["readings"][s] for s in contract.sensors}
    parsed = parsed.withColumns({"timestamp": F.try_to_timestamp(e["timestamp"]), **texts})
    parsed = parsed.withColumns({s: F.col(f"_text_{s}").try_cast("double") for s in contract.sensors})
    return parsed.select(
        "raw",
        *keep,
        e["event_id"].alias("event_id"),
        "timestamp",
        e["station_id"].alias("station_id"),
        e["device_id"].alias("device_id"),
        *contract.sensors,
        reject_reason(e, {s: (F.col(f"_text_{s}"), F.col(s)) for s in contract.sensors}).alias("reason"),
    )


def reject_reason(event: Column, values: dict[str, tuple[Column, Column]]) -> Column:
    """Why an event cannot be used, or NULL; of every sensor the text and the number it gives."""
    unreadable = F.coalesce(event["event_type"] != SENSOR_READING, F.lit(True)) | event["readings"].isNull()
    incomplete = F.lit(False)
    for name in ("event_id", "timestamp", "station_id", "device_id"):
        incomplete = incomplete | event[name].isNull()
    mistyped = F.col("timestamp").isNull()
    for text, number in values.values():
        mistyped = mistyped | (text.isNotNull() & number.isNull())
    return (
        F.when(unreadable, CORRUPT).when(incomplete, MISSING_FIELD).when(mistyped, BAD_TYPE)
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "raw")


def dead_letters(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("event_id", "reason", "raw", *keep)


def dedupe(events: DataFrame) -> DataFrame:
    """One row per ``event_id`` in a batch frame; of differing copies the smallest row is kept.

    An aggregate rather than a window: copies collapse before the shuffle, so an event delivered
    millions of times does not fill a task.
    """
    rest = [c for c in events.columns if c != "event_id"]
    kept = events.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("_row"))
    return kept.select("event_id", "_row.*").select(*events.columns)


def long_readings(events: DataFrame, contract: Contract) -> DataFrame:
    """One row per event and sensor."""
    keys = ["event_id", "timestamp", "station_id", "device_id"]
    return unpivot(events.select(*keys, *contract.sensors), keys, contract.sensors, "sensor", "value")


def event_json(readings: DataFrame, contract: Contract) -> Column:
    """The JSON text of a good event, built from a readings row."""
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"),
            F.lit(SENSOR_READING).alias("event_type"),
            stamp.alias("timestamp"),
            "station_id",
            "device_id",
            F.struct(*contract.sensors).alias("readings"),
        ),
        {"ignoreNullFields": "false"},
    )
