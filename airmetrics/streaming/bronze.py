"""Bronze in few files: many micro-batches of a day rewritten as one version, switched at once.

Micro-batches lie in ``bronze/day=../batch_id=..``. A compaction rewrites whole days into
``bronze_compact/version=../day=..`` and then appends one file to ``bronze_versions`` that says, for each of its
days, up to which batch the version holds it. That file is the switch: before it readers see the
micro-batches, after it the version and only later micro-batches. Every row keeps its batch id, so what
readers get is the same.

The newest batch is never taken in: it is the only one that a stream may write again. What a compaction
has replaced is deleted by the next one, so a reader may run as long as there is one compaction between. One
compaction runs at a time; one that died leaves a version that nothing names, and the next deletes it.
The driver handles names of folders and one entry per compacted day, no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from datetime import date
from typing import NamedTuple
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.sources.folders import child_folders, delete_folders, drop_partitions_before, path_exists

VERSIONS = "version string, day date, upto bigint"
MIN_BATCHES = 16
_BATCH = re.compile(r"/day=(\d{4}-\d\d-\d\d)/batch_id=(\d+)/")


class Current(NamedTuple):
    """The version that holds a day's batches up to ``upto``."""

    version: str
    upto: int


class Bronze:
    """Micro-batches and compacted days of one consumer, under one folder."""

    def __init__(self, base: str, schema: str):
        self.raw, self.compact, self.versions = f"{base}/bronze", f"{base}/bronze_compact", f"{base}/bronze_versions"
        self.schema = schema

    def current(self, spark: SparkSession) -> dict[date, Current]:
        """Of every compacted day the version that holds most batches."""
        if not path_exists(spark, self.versions):
            return {}
        rows = spark.read.schema(VERSIONS).parquet(self.versions).groupBy("day")
        newest = rows.agg(F.max(F.struct("upto", "version")).alias("v")).select("day", "v.version", "v.upto")
        return {r.day: Current(r.version, r.upto) for r in newest.collect()}

    def read(self, spark: SparkSession) -> DataFrame:
        """Every row once; days and versions are partitions, so only the files named are opened."""
        current = self.current(spark)
        raw = self._read(spark, self.raw)
        if not current:
            return raw
        days: dict[Current, list[date]] = defaultdict(list)
        for day, version in current.items():
            days[version].append(day)
        held, later = F.lit(False), F.lit(True)
        for version, own in days.items():
            held = held | ((F.col("version") == version.version) & F.col("day").isin(own))
            later = later & ~(F.col("day").isin(own) & (F.col("batch_id") <= version.upto))
        compacted = spark.read.schema(f"{self.schema}, version string").parquet(self.compact).filter(held)
        columns = self._read(spark, self.raw).columns
        return raw.filter(later).unionByName(compacted.select(*columns))

    def compacted(self, spark: SparkSession, min_batches: int = MIN_BATCHES) -> list[date]:
        """Rewrite the days that have at least ``min_batches`` micro-batches of their own; returns them."""
        self.clean(spark)
        current = self.current(spark)
        batches: dict[date, set[int]] = defaultdict(set)
        if path_exists(spark, self.raw):
            for name in self._read(spark, self.raw).inputFiles():
                if found := _BATCH.search(unquote(name)):
                    batches[date.fromisoformat(found[1])].add(int(found[2]))
        upto = max((max(own) for own in batches.values()), default=0) - 1
        waiting = {
            day: sum(current[day].upto < b <= upto if day in current else b <= upto for b in own) for day, own in batches.items()
        }
        days = sorted(day for day, count in waiting.items() if count >= min_batches)
        if not days:
            return []
        version = uuid4().hex
        rows = self.read(spark).filter(F.col("day").isin(days) & (F.col("batch_id") <= upto))
        rows.hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.compact}/version={version}")
        entry = spark.createDataFrame([(version, day, upto) for day in days], VERSIONS)
        entry.coalesce(1).write.mode("append").parquet(self.versions)
        return days

    def clean(self, spark: SparkSession) -> None:
        """Delete micro-batches that a version holds, versions of days held by a newer one, and unfinished ones."""
        current = self.current(spark)
        gone = []
        for day, (_, upto) in current.items():
            for name, path in child_folders(spark, f"{self.raw}/day={day}", "batch_id"):
                if int(name) <= upto:
                    gone.append(path)
        used = {version for version, _ in current.values()}
        for version, path in child_folders(spark, self.compact, "version"):
            if version not in used:
                gone.append(path)
                continue
            for day, inner in child_folders(spark, path, "day"):
                held = current.get(date.fromisoformat(day))
                if held is None or held.version != version:
                    gone.append(inner)
        delete_folders(spark, gone)

    def drop_before(self, spark: SparkSession, day: str) -> list[str]:
        """Remove days before ``day``, compacted or not."""
        dropped = set(drop_partitions_before(spark, self.raw, "day", day))
        for _, path in child_folders(spark, self.compact, "version"):
            dropped.update(drop_partitions_before(spark, path, "day", day))
        return sorted(dropped)

    def _read(self, spark: SparkSession, path: str) -> DataFrame:
        if not path_exists(spark, path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(path)
