"""Readings, stations and raw events derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.contract import Contract
from airmetrics.sources.events import event_json

CONTRACT = Contract.compressed_air()
SENSORS = CONTRACT.sensors

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)

# How the event table is read as compressor readings.
PROJECTION = (
    "event_id",
    "cast(ts as timestamp) as timestamp",
    "concat('station_', user_id % 4) as station_id",
    "concat('compressor_', (user_id div 4) % 3) as device_id",
    "case when event_type = 'error' then null else value / 8.0D end as discharge_pressure",
    "case when k % 10 = 0 then null when event_type = 'signup' then 0.0D else value * 4.0D end as air_flow_rate",
    "case when k % 17 = 0 then null when event_type = 'signup' then 0.0D else value end as power_consumption",
    "cast(case when event_type = 'signup' then 0 else k * 45 end as double) as motor_speed",
    "cast(case when k % 25 = 0 then null else 25.0 + 30.0 * (k div 50) end as double) as discharge_temp",
)


def _project(events: DataFrame) -> DataFrame:
    with_k = events.withColumn("k", F.expr("cast(get_json_object(props, '$.k') as int)"))
    return with_k.selectExpr(*PROJECTION)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _project(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station metadata, one station per nation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "concat('station_', n_nationkey) as station_id",
        "n_name as station_name",
        "r_name as location",
        "date_add(date'2020-01-01', n_nationkey) as commissioned_date",
        "bigint(n_nationkey % 12) as num_compressors",
    )


def raw_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of JSON text, with broken events and repeated deliveries."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return as_raw(_project(source))


def as_raw(rows: DataFrame) -> DataFrame:
    """One JSON text per delivery.

    Of every 50 events one lacks its ids, one has bad types and one is garbage; every seventh
    event is delivered twice.
    """
    event_id = F.col("event_id").cast("string").alias("event_id")
    kind = F.lit("sensor_reading").alias("event_type")
    stamp = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    lacking = F.to_json(F.struct(event_id, kind, F.struct("discharge_pressure").alias("readings")))
    mistyped = F.to_json(
        F.struct(
            event_id,
            kind,
            stamp.alias("timestamp"),
            "station_id",
            "device_id",
            F.struct(
                F.lit("not_a_number").alias("discharge_pressure"),
                F.array(F.lit(1), F.lit(2), F.lit(3)).alias("air_flow_rate"),
            ).alias("readings"),
        )
    )
    garbage = F.to_json(F.struct(event_id, F.lit("this is not a valid event").alias("garbage")))
    turn = F.col("event_id") % 50
    text = (
        F.when(turn == 0, lacking)
        .when(turn == 1, mistyped)
        .when(turn == 2, garbage)
        .otherwise(event_json(rows, CONTRACT))
    )
    copies = F.when(F.col("event_id") % 7 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(text.alias("raw"), F.explode(copies).alias("copy")).select("raw")
