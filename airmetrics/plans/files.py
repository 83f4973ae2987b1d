"""Incremental runs over a folder of files: only files that are new or replaced are read.

The rows per station and day, and the sum of their hashes, add up over files. So every file version
(name, length, time of change) is hashed once and its days are kept; what a day holds now is the sum
over the files that are there now. Days are then compared with the ledger of finished runs as in
:mod:`airmetrics.plans.incremental`, and a run reads only the files that hold pending days. New,
replaced and deleted files are all found; without any of them no data file is opened.

A file is known by length and time of change: one that is replaced with both unchanged is not seen
(``process_pending`` hashes every row). A file replaced during a run is found by the next one. File
names pass through the driver, which lists the folder anyway; rows do not. Versions hashed under
another contract, unit or format do not count. With very many files, bound the tasks of the listing by
``spark.sql.files.maxPartitionNum``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.contract import Contract
from airmetrics.plans.incremental import PERIODS, STATE, changed_days, day_states, read_ledger, run_days
from airmetrics.plans.lookback import update
from airmetrics.sources.folders import is_folder, path_exists
from airmetrics.sources.readings import ReadingSource, empty_readings, read_readings

VERSION = ("path", "length", "modified")
FILES = "path string, length bigint, modified timestamp, scan_id string, reader string"
FILE_DAYS = "path string, station_id string, period date, rows bigint, content_high bigint, content_low bigint, scan_id string"
LISTING_OPTIONS = ("pathGlobFilter", "recursiveFileLookup", "modifiedAfter", "modifiedBefore")
# Spark escapes the names it reports for rows, not those it lists.
FILE_OF_ROW = "url_decode(replace(_metadata.file_path, '+', '%2B'))"


def process_files(
    spark: SparkSession,
    source: ReadingSource,
    path: str,
    ledger: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """Run the days of new, replaced and deleted files, store their snapshots, return the receipts."""
    pending, readings = pending_files(spark, source, ledger, contract)
    return run_days(spark, readings, pending, path, ledger, contract, config)


def process_files_with_lookback(
    spark: SparkSession,
    source: ReadingSource,
    path: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
) -> DataFrame:
    """The same for days that add up across midnight; returns the days run."""
    pending, readings = pending_files(spark, source, path, contract)
    return update(spark, readings, path, contract, config, pending)


def pending_files(
    spark: SparkSession, source: ReadingSource, ledger: str, contract: Contract
) -> tuple[DataFrame, Callable[[Sequence[date]], DataFrame]]:
    """Hash what is new; the pending days, and a reader of the files that hold given days."""
    there = list_files(spark, source)
    first = not path_exists(spark, f"{ledger}/done")
    scan_files(spark, source, there, ledger, contract)
    states = _days_of(spark, there, ledger, _reader(source, contract))
    known = states.filter(F.col("station_id").isNotNull() & F.col("period").isNotNull())
    now = known.groupBy(*PERIODS).agg(*[F.sum(c).alias(c) for c in STATE])

    def readings(days: Sequence[date]) -> DataFrame:
        if not days or first:
            return read_readings(spark, source, contract) if days else empty_readings(spark, contract)
        holding = states.filter(F.col("period").isin(list(days))).select("path").distinct()
        return _read(spark, source, [r.path for r in holding.collect()], contract)

    return changed_days(now, read_ledger(spark, ledger)), readings


def list_files(spark: SparkSession, source: ReadingSource) -> DataFrame:
    """Name, length and time of change of the source's files; no file is opened."""
    if source.path is None:
        raise ValueError("only sources with a path consist of files")
    options = {k: v for k, v in source.options.items() if k in LISTING_OPTIONS}
    files = spark.read.format("binaryFile").options(**options).load(source.path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def scan_files(
    spark: SparkSession, source: ReadingSource, there: DataFrame, ledger: str, contract: Contract
) -> list[str]:
    """Hash the file versions not yet known and store what their days hold; returns their names.

    The days are written first: a scan that dies half-way leaves rows under a name that no file
    refers to, and is repeated.
    """
    scan_id, reader = uuid4().hex, _reader(source, contract)
    known = _versions(spark, ledger, reader)
    fresh = there.join(known, on=list(VERSION), how="left_anti").collect()
    if not fresh:
        return []
    names = [r.path for r in fresh]
    # The first time these are all files there are.
    whole = not path_exists(spark, f"{ledger}/files")
    rows = read_readings(spark, source, contract) if whole else _read(spark, source, names, contract)
    states = day_states(rows.withColumn("path", F.expr(FILE_OF_ROW)), ("path",))
    states.withColumn("scan_id", F.lit(scan_id)).write.mode("append").parquet(f"{ledger}/file_days")
    versions = spark.createDataFrame([(*r, scan_id, reader) for r in fresh], FILES)
    versions.coalesce(1).write.mode("append").parquet(f"{ledger}/files")
    return names


def _versions(spark: SparkSession, ledger: str, reader: str) -> DataFrame:
    """Known file versions, each with one scan that hashed it."""
    if not path_exists(spark, f"{ledger}/files"):
        rows = spark.createDataFrame([], FILES)
    else:
        rows = spark.read.schema(FILES).parquet(f"{ledger}/files").filter(F.col("reader") == reader)
    return rows.groupBy(*VERSION).agg(F.min("scan_id").alias("scan_id"))


def _days_of(spark: SparkSession, there: DataFrame, ledger: str, reader: str) -> DataFrame:
    """What the files that are there now hold, per file, station and day."""
    if not path_exists(spark, f"{ledger}/file_days"):
        return spark.createDataFrame([], FILE_DAYS)
    current = there.join(_versions(spark, ledger, reader), on=list(VERSION)).select("path", "scan_id")
    return spark.read.schema(FILE_DAYS).parquet(f"{ledger}/file_days").join(current, on=["path", "scan_id"])


def _read(spark: SparkSession, source: ReadingSource, names: list[str], contract: Contract) -> DataFrame:
    """Readings of the named files; folder columns stay those of the whole source."""
    if not names:
        return empty_readings(spark, contract)
    options = source.options
    if is_folder(spark, source.path):
        options = {**options, "basePath": source.path}
    plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", n) for n in names]
    return read_readings(spark, replace(source, path=plain, options=options), contract)


def _reader(source: ReadingSource, contract: Contract) -> str:
    """What decides how a file's bytes become readings."""
    columns = [(c.name, c.dtype) for c in contract.columns]
    return hashlib.sha256(repr((columns, source.format, sorted(source.units.items()))).encode()).hexdigest()
