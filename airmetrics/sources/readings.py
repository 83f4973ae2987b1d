"""Readings source: any table Spark can read, projected onto the contract."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.compressed_air import COLUMN_ALIASES
from airmetrics.contract import Contract
from airmetrics.functions.time import bound_literal, parse_bound
from airmetrics.operators.evolve import convert_units, normalise_types, rename_aliases, select_known


@dataclass(frozen=True)
class ReadingSource:
    """Where readings live: a Spark format with a path, or a catalog table.

    ``options`` go to the reader (for JDBC: ``url``, ``dbtable`` and the partitioning options).
    ``day_column`` names a date partition column, used to prune partitions by the time range.
    ``units`` names columns delivered in another unit than the contract's.
    """

    path: str | list[str] | None = None
    format: str = "parquet"
    table: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    day_column: str | None = None
    units: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession, contract: Contract) -> DataFrame:
        if self.table is not None:
            return spark.read.table(self.table)
        reader = spark.read.format(self.format).options(**self.options)
        if self.format == "json":
            # Text keeps bad values visible to the checks; inference would read the data twice.
            names = [c.name for c in contract.columns]
            old = {a: c for a, c in COLUMN_ALIASES.items() if c in names and a not in names}
            reader = reader.schema(", ".join(f"`{n}` string" for n in ("event_id", *names, *old)))
            rows = reader.load(self.path) if self.path is not None else reader.load()
            # The schema is ours: a column stands in it whether the lines have it or not.
            both = {c: F.coalesce(c, *[a for a in old if old[a] == c]) for c in old.values()}
            return rows.withColumns(both).drop(*old)
        if self.format == "csv":
            reader = reader.option("header", "true")
        return reader.load(self.path) if self.path is not None else reader.load()

    def columns(self, spark: SparkSession, contract: Contract) -> list[str]:
        """Names the source really has; for JSON that takes a pass over the lines."""
        if self.table is None and self.format == "json":
            return spark.read.options(**self.options).json(self.path).columns
        return self.load(spark, contract).columns


def read_readings(
    spark: SparkSession,
    source: ReadingSource | DataFrame | str,
    contract: Contract,
    stations: Sequence[str] | str | None = None,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    strict: bool = False,
) -> DataFrame:
    """Contract columns of the wanted stations and the inclusive time range ``[start, end]``.

    All filters apply before any series work and reach the scan when the source column already
    has its contract type. An empty result keeps its schema. Columns that neither the contract nor
    its old names know are left out, or an error with ``strict``.
    """
    if isinstance(source, str):
        source = ReadingSource(source)
    if isinstance(source, ReadingSource):
        day, units, df = source.day_column, source.units, source.load(spark, contract)
    else:
        day, units, df = None, {}, source
    if strict:
        have = source.columns(spark, contract) if isinstance(source, ReadingSource) else df.columns
        select_known(
            rename_aliases(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in have))),
            contract,
            strict=True,
            allowed=("event_id", *([day] if day else [])),
        )
    df = rename_aliases(df)
    if stations is not None:
        wanted = [stations] if isinstance(stations, str) else list(stations)
        df = df.filter(F.col("station_id").isin(wanted))
    if day is not None:
        lo, hi = parse_bound(start), parse_bound(end)
        if lo is not None:
            df = df.filter(F.col(day) >= F.lit(lo.date()))
        if hi is not None:
            df = df.filter(F.col(day) <= F.lit(hi.date()))
    names = [c.name for c in contract.columns]
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"source lacks contract columns: {absent}")
    extra = ["event_id"] if "event_id" in df.columns else []
    df = normalise_types(df.select(*extra, *names), contract)
    return time_range(convert_units(df, contract, units), start, end)


def time_range(
    df: DataFrame, start: str | datetime | None = None, end: str | datetime | None = None
) -> DataFrame:
    """Inclusive range on ``timestamp``; either side may be open."""
    lo, hi = bound_literal(start), bound_literal(end)
    if lo is not None:
        df = df.filter(F.col("timestamp") >= lo)
    if hi is not None:
        df = df.filter(F.col("timestamp") <= hi)
    return df


def empty_readings(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([], contract.struct_type())
