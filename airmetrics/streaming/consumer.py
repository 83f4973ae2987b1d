"""The event consumer: raw stream in; bronze, dead letters, status and snapshots out.

Every micro-batch is written under its own batch id and overwrites exactly that on a retry.
Snapshots are recomputed from bronze for the (station, day) pairs a batch touched, with the batch
plan, so streamed and batch results are the same numbers. Delivery may repeat events: bronze keeps
what arrived, readers see each ``event_id`` once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from airmetrics.config import PipelineConfig
from airmetrics.contract import Contract
from airmetrics.functions.time import bound_literal
from airmetrics.operators.quality import count_if
from airmetrics.operators.series import Layout
from airmetrics.plans.incremental import PERIODS, STATE
from airmetrics.plans.lookback import totals, update
from airmetrics.plans.stations import run_pipeline
from airmetrics.sources.events import (
    BAD_TYPE,
    CORRUPT,
    MISSING_FIELD,
    dead_letters,
    dedupe,
    good_events,
    parse_events,
)
from airmetrics.sources.folders import drop_partitions_before, path_exists
from airmetrics.sources.readings import time_range
from airmetrics.sources.snapshots import read_snapshots, snapshot_versions, write_snapshots
from airmetrics.streaming.bronze import MIN_BATCHES, Bronze

REASONS = (MISSING_FIELD, BAD_TYPE, CORRUPT)
DEAD_LETTER = "event_id string, reason string, raw string, ingested_at timestamp, ingest_day date, batch_id bigint"
STATUS = (
    "ingested_at timestamp, received bigint, processed bigint, "
    + ", ".join(f"{r} bigint" for r in REASONS)
    + ", last_event_at timestamp, late bigint, newest_event_at timestamp, watermark timestamp, "
    + "started_at timestamp, finished_at timestamp, batch_id bigint"
)


@dataclass(frozen=True)
class StreamTables:
    """Tables of one consumer, all under one folder of the shared file system."""

    base: str
    contract: Contract

    @property
    def bronze(self) -> Bronze:
        return Bronze(self.base, self.bronze_schema())

    @property
    def dead(self) -> str:
        return f"{self.base}/dead_letters"

    @property
    def status(self) -> str:
        return f"{self.base}/status"

    @property
    def snapshots(self) -> str:
        return f"{self.base}/snapshots"

    @property
    def days(self) -> str:
        return f"{self.base}/days"

    @property
    def late(self) -> str:
        return f"{self.base}/late"

    @property
    def late_done(self) -> str:
        return f"{self.base}/late_done"

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"

    def bronze_schema(self) -> str:
        sensors = ", ".join(f"{s} double" for s in self.contract.sensors)
        ids = "event_id string, timestamp timestamp, station_id string, device_id string"
        return f"{ids}, {sensors}, ingested_at timestamp, day date, batch_id bigint"

    def read_bronze(self, spark: SparkSession) -> DataFrame:
        return self.bronze.read(spark)

    def readings(self, spark: SparkSession, days: list | None = None) -> DataFrame:
        """Deduplicated readings of the given days, ready for a run by period."""
        rows = self.read_bronze(spark)
        if days is not None:
            rows = rows.filter(F.col("day").isin(days))
        kept = dedupe(rows.drop("ingested_at", "batch_id"))
        return kept.withColumnRenamed("day", "period")

    def read_dead_letters(self, spark: SparkSession) -> DataFrame:
        return _read(spark, self.dead, DEAD_LETTER)

    def read_late(self, spark: SparkSession) -> DataFrame:
        """Events that came behind the watermark of their batch, with that watermark."""
        return _read(spark, self.late, f"{self.bronze_schema()}, watermark timestamp")


def start_stream(
    raw: DataFrame,
    base: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
    trigger: dict | None = None,
    query_name: str | None = None,
    lookback: bool = False,
    snapshots: bool = True,
    lateness: str | None = None,
) -> StreamingQuery:
    """Start the consumer on a stream with a ``raw`` string column.

    The default trigger works off what is there and stops. With ``lookback`` the days are also kept
    as summaries that add up across midnight (see :func:`day_totals`). Without ``snapshots`` events are
    only landed; ``replay`` computes the days. With ``lateness`` (an interval such as ``1 hour``) events
    further than that behind the newest one of earlier batches go to the late table as well, and days
    that only they touch wait for :func:`replay_late` instead of being redone at once. Bound the size of a micro-batch at
    the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """
    tables = StreamTables(base, contract)
    # The batch time is part of Spark's offset log: a repeated batch gets the same value.
    stamped = raw.select("raw", F.current_timestamp().alias("ingested_at"))
    handler = batch_handler(tables, config, lookback, snapshots, lateness)
    writer = stamped.writeStream.foreachBatch(handler)
    writer = writer.option("checkpointLocation", tables.checkpoint)
    if query_name is not None:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def batch_handler(
    tables: StreamTables,
    config: PipelineConfig = PipelineConfig(),
    lookback: bool = False,
    snapshots: bool = True,
    lateness: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """What happens to one micro-batch; any transport may call it."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, started = batch.sparkSession, datetime.now(timezone.utc)
        newest = newest_event(spark, tables, batch_id)
        # Null for the first batch, and without a lateness: nothing is behind it.
        mark = F.timestamp_micros(F.lit(newest if lateness else None).cast("bigint")) - F.expr(f"INTERVAL {lateness or '0 seconds'}")
        parsed = parse_events(batch, tables.contract, keep=("ingested_at",))
        # Read four times below; its size is bounded by the source's rate limit. Only rejected events need their text.
        parsed = parsed.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw"))).persist()
        try:
            good = good_events(parsed).withColumn("day", F.to_date("timestamp"))
            _write_batch(good, tables.bronze.raw, batch_id, "day")
            dead = dead_letters(parsed, keep=("ingested_at",))
            dead = dead.withColumn("ingest_day", F.to_date("ingested_at"))
            _write_batch(dead, tables.dead, batch_id, "ingest_day")
            fresh = good
            if lateness is not None:
                behind = F.coalesce(F.col("timestamp") < mark, F.lit(False))
                _write_batch(good.filter(behind).withColumn("watermark", mark), tables.late, batch_id, "day")
                fresh = good.filter(~behind)
            touched = fresh.select("station_id", F.col("day").alias("period")).distinct()
            # Calendar days of one batch, not rows: they prune bronze to the folders needed.
            days = [r.period for r in touched.select("period").distinct().collect()]
            if days:
                _run_days(spark, tables, days, touched, config, f"stream-{batch_id}", snapshots, lookback)
            status = batch_status(parsed, mark)
            before = F.timestamp_micros(F.lit(newest).cast("bigint"))
            status = status.withColumns(
                {
                    "newest_event_at": F.greatest(before, "last_event_at"),
                    "watermark": mark,
                    "started_at": F.lit(started),
                    "finished_at": F.current_timestamp(),
                }
            )
            _write_batch(status, tables.status, batch_id)
        finally:
            parsed.unpersist()

    return handle


def _run_days(
    spark: SparkSession,
    tables: StreamTables,
    days: list,
    touched: DataFrame,
    config: PipelineConfig,
    run_id: str,
    snapshots: bool,
    lookback: bool,
) -> None:
    """Run the touched (station, day) pairs from bronze: their snapshots, their summaries, or both."""
    readings = tables.readings(spark, days).join(touched, on=list(PERIODS), how="left_semi")
    if lookback:
        # Read for the snapshots, the edges and the summaries: copies are removed once.
        readings = readings.persist()
    try:
        if snapshots:
            bronze = tables.read_bronze(spark).filter(F.col("day").isin(days))
            _store(readings, bronze, tables, config, run_id)
        if lookback:
            add_days(spark, tables, touched, config, run_id, readings.drop("period"))
    finally:
        if lookback:
            readings.unpersist()


def add_days(
    spark: SparkSession,
    tables: StreamTables,
    touched: DataFrame,
    config: PipelineConfig,
    batch_id: str,
    held: DataFrame | None = None,
) -> None:
    """Bring the day summaries up to date with the touched days, and with days that look at them.

    ``held`` are the readings of the touched days, where they are at hand.
    """
    pending = touched.withColumns({c: F.lit(0).cast("bigint") for c in STATE})

    def readings(days: list) -> DataFrame:
        return tables.readings(spark, days).drop("period")

    update(spark, readings, tables.days, tables.contract, config, pending, batch_id, held)


def day_totals(
    spark: SparkSession,
    tables: StreamTables,
    config: PipelineConfig = PipelineConfig(),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Metrics per device over the streamed days; over all of them, those of one run over bronze."""
    return totals(spark, tables.days, tables.contract, config, start, end)


def _store(
    readings: DataFrame, bronze: DataFrame, tables: StreamTables, config: PipelineConfig, batch_id: str | None
) -> None:
    """Run days and store them. Slices are measured on bronze, which needs no deduplication."""
    keys = (*PERIODS, "device_id")
    layout = Layout.of(bronze.withColumnRenamed("day", "period"), config.chunk, keys)
    run = run_pipeline(readings, tables.contract, config, by=PERIODS, layout=layout)
    write_snapshots(run.results, tables.snapshots, batch_id=batch_id)


def replay(
    spark: SparkSession,
    tables: StreamTables,
    start: str | None = None,
    end: str | None = None,
    config: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """Rebuild the snapshots of all days in ``[start, end]`` from bronze."""
    rows = tables.read_bronze(spark)
    lo, hi = bound_literal(start), bound_literal(end)
    if lo is not None:
        rows = rows.filter(F.col("day") >= F.to_date(lo))
    if hi is not None:
        rows = rows.filter(F.col("day") <= F.to_date(hi))
    readings = dedupe(rows.drop("ingested_at", "batch_id")).withColumnRenamed("day", "period")
    _store(readings, rows, tables, config, None)
    return read_snapshots(spark, tables.snapshots, start=start, end=end)


def newest_event(spark: SparkSession, tables: StreamTables, batch_id: int) -> int | None:
    """The newest event time of the batches before this one, in microseconds; the first has none.

    Every batch's status carries it on, so a repeated batch and a restarted stream get the same one, and
    only the folder of the batch before is read; where ids have gaps, all are.
    """
    last = f"{tables.status}/batch_id={batch_id - 1}"
    if path_exists(spark, last):
        rows = spark.read.schema(STATUS).parquet(last)
    else:
        rows = _read(spark, tables.status, STATUS).filter(F.col("batch_id") < batch_id)
    newest = F.unix_micros(F.max(F.greatest("last_event_at", "newest_event_at"))).alias("newest")
    return rows.agg(newest).first().newest


def late_days(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """Stations and days with late events that no replay has taken in, with their number."""
    done = _read(spark, tables.late_done, "batch_id bigint, replay_id string")
    rows = tables.read_late(spark).join(done.select("batch_id").distinct(), on="batch_id", how="left_anti")
    return rows.groupBy("station_id", F.col("day").alias("period")).agg(F.count(F.lit(1)).alias("events"))


def replay_late(
    spark: SparkSession, tables: StreamTables, config: PipelineConfig = PipelineConfig(), lookback: bool = False
) -> DataFrame:
    """Run the days that wait for late events, each once, and return what was stored for them.

    What is taken in is settled first and marked done last: a replay that dies is repeated, and events
    that come meanwhile wait for the next one. The newest batch may still be written again; it is taken
    in all the same, since a repeated batch holds the same events.
    """
    replay_id, started = f"late-{uuid4().hex}", datetime.now(timezone.utc)
    done = _read(spark, tables.late_done, "batch_id bigint, replay_id string").select("batch_id").distinct()
    # Numbers of micro-batches, not rows.
    batches = [r.batch_id for r in tables.read_late(spark).select("batch_id").distinct().join(done, "batch_id", "left_anti").collect()]
    taken = tables.read_late(spark).filter(F.col("batch_id").isin(batches))
    touched = taken.select("station_id", F.col("day").alias("period")).distinct()
    days = [r.period for r in touched.select("period").distinct().collect()]
    if days:
        _run_days(spark, tables, days, touched, config, replay_id, True, lookback)
        marks = spark.createDataFrame([(b, replay_id) for b in batches], "batch_id bigint, replay_id string")
        marks.coalesce(1).write.mode("append").parquet(tables.late_done)
    return snapshot_versions(spark, tables.snapshots, started).filter(F.col("batch_id") == replay_id)


def compact_bronze(spark: SparkSession, tables: StreamTables, min_batches: int = MIN_BATCHES) -> list:
    """Rewrite days of many micro-batches as few files; returns the days (see :mod:`airmetrics.streaming.bronze`)."""
    return tables.bronze.compacted(spark, min_batches)


def backfill(
    spark: SparkSession,
    tables: StreamTables,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Deduplicated bronze readings of a time range, late ones included."""
    return time_range(tables.readings(spark), start, end)


def drop_dead_letters_before(spark: SparkSession, tables: StreamTables, day: str) -> list[str]:
    """Retention: remove dead letters ingested before ``day``."""
    return drop_partitions_before(spark, tables.dead, "ingest_day", day)


def drop_bronze_before(spark: SparkSession, tables: StreamTables, day: str) -> list[str]:
    """Retention: remove bronze readings of days before ``day``; they can no longer be replayed."""
    return tables.bronze.drop_before(spark, day)


def drop_snapshots_before(spark: SparkSession, tables: StreamTables, month: str) -> list[str]:
    """Retention: remove snapshots of months (``yyyy-MM``) before ``month``; empty windows stay."""
    return drop_partitions_before(spark, tables.snapshots, "window_month", month)


def batch_status(parsed: DataFrame, watermark: Column | None = None) -> DataFrame:
    """One row of counts for a parsed batch; ``late`` are good events behind the watermark."""
    behind = F.lit(False) if watermark is None else F.coalesce(F.col("timestamp") < watermark, F.lit(False))
    return parsed.agg(
        F.max("ingested_at").alias("ingested_at"),
        F.count(F.lit(1)).alias("received"),
        count_if(F.col("reason").isNull()).alias("processed"),
        *[count_if(F.col("reason") == r).alias(r) for r in REASONS],
        F.max(F.when(F.col("reason").isNull(), F.col("timestamp"))).alias("last_event_at"),
        count_if(F.col("reason").isNull() & behind).alias("late"),
    )


def processing_status(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """Totals over all batches: received, processed, errors by reason, and event-time lag."""
    rows = _read(spark, tables.status, STATUS)
    errors = sum((F.col(r) for r in REASONS[1:]), F.col(REASONS[0]))
    return rows.agg(
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum("received"), F.lit(0)).alias("received"),
        F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(errors), F.lit(0)).alias("errors"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in REASONS],
        F.max("last_event_at").alias("last_event_at"),
        F.max("ingested_at").alias("last_ingested_at"),
        F.timestamp_diff("SECOND", F.max("last_event_at"), F.max("ingested_at")).alias("lag_seconds"),
    )


def batch_log(spark: SparkSession, tables: StreamTables) -> DataFrame:
    """One row per micro-batch: counts, late events, watermark, event-time lag, time taken and rate.

    A repeated batch has the row of its last try.
    """
    errors = sum((F.coalesce(r, F.lit(0)) for r in REASONS[1:]), F.coalesce(REASONS[0], F.lit(0)))
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return _read(spark, tables.status, STATUS).select(
        "batch_id",
        "received",
        "processed",
        errors.alias("errors"),
        F.coalesce("late", F.lit(0)).alias("late"),
        "last_event_at",
        "newest_event_at",
        "watermark",
        F.timestamp_diff("SECOND", F.col("newest_event_at"), F.col("ingested_at")).alias("lag_seconds"),
        seconds.alias("seconds"),
        F.try_divide("received", seconds).alias("rows_per_second"),
    )


def backlog_status(spark: SparkSession, source: str, tables: StreamTables) -> DataFrame:
    """One row: what waits at a file source, and the lag and rate of the newest batch.

    It reads tables and the checkpoint only, so it works while the stream is down.
    """
    waits = waiting(spark, source, tables).agg(
        F.count(F.lit(1)).alias("waiting_files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("waiting_bytes"),
        F.min("modificationTime").alias("waiting_since"),
    )
    newest = F.max_by(F.struct("batch_id", "newest_event_at", "lag_seconds", "rows_per_second"), "batch_id").alias("_b")
    # Two rows, one of each.
    return waits.join(batch_log(spark, tables).agg(newest), how="inner", on=F.lit(True)).select(*waits.columns, "_b.*")


def backlog(query: StreamingQuery) -> dict:
    """What the source reports as still waiting, with the current rates.

    ``dropped_late`` counts rows behind the watermark that the last batch left out of its state;
    bronze keeps them, and ``replay`` brings them back.
    """
    progress = query.lastProgress
    if progress is None:
        return {"batch_id": None, "input_rows": 0, "watermark": None, "dropped_late": 0, "sources": []}
    return {
        "batch_id": progress["batchId"],
        "input_rows": progress["numInputRows"],
        "watermark": (progress.get("eventTime") or {}).get("watermark"),
        "dropped_late": sum(s.get("numRowsDroppedByWatermark") or 0 for s in progress["stateOperators"]),
        "sources": [
            {"source": s["description"], "waiting": dict(s.get("metrics") or {})}
            for s in progress["sources"]
        ],
    }


def waiting(spark: SparkSession, source: str, tables: StreamTables) -> DataFrame:
    """Files of a file source that no batch has taken up yet, from the checkpoint's file log."""
    plain = "regexp_replace(%s, '^file:/+', 'file:/')"
    # Only names, lengths and times are read, not the content of the files.
    files = spark.read.format("binaryFile").load(source)
    there = files.select(F.expr(f"{plain % 'path'} AS path"), "length", "modificationTime")
    log = f"{tables.checkpoint}/sources/0"
    if not path_exists(spark, log):
        return there
    taken = "url_decode(replace(get_json_object(value, '$.path'), '+', '%2B'))"
    lines = spark.read.text(log).filter(F.col("value").startswith("{"))
    return there.join(lines.select(F.expr(f"{plain.replace('%s', taken)} AS path")), "path", "left_anti")


def waiting_files(spark: SparkSession, source: str, tables: StreamTables) -> int:
    """How many files of a file source no batch has taken up yet."""
    return waiting(spark, source, tables).count()


def _write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Write one batch's rows; a repeated batch replaces its own partitions and nothing else."""
    rows = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if partitions:
        # Adaptive planning gathers small partitions into few files and splits large ones.
        rows = rows.hint("rebalance", *partitions)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions, "batch_id").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
