"""The station run: validate, repair, resample, report, measure — all stations in one plan.

The raw rows are shuffled once, by device (or device and time slice). Everything a report needs
from raw rows travels with them as one integer of flags and is summed while resampling, so after
that shuffle only bucket rows move, then device rows, then station rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airmetrics.config import MissingData, PipelineConfig
from airmetrics.contract import Contract
from airmetrics.functions.time import MINUTE, iso_text, parse_rule, time_bucket
from airmetrics.operators.flatlines import flatline_counts, flatlines_ending_here
from airmetrics.operators.impute import impute
from airmetrics.operators.metrics import METRICS, metric_aggregates, previous_values
from airmetrics.operators.quality import count_if, score
from airmetrics.operators.resample import fill_grid
from airmetrics.operators.segments import combine_all, metrics_of, segment_width, summaries
from airmetrics.operators.series import TIE, Layout
from airmetrics.sources.snapshots import DEVICE, QUALITY, RESULT, receipts, write_snapshots

DEVICE_ID = "device_id"
FLAGS = "_flags"
UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


class StationRun:
    """Lazy results of a run; each frame is planned when asked for and computes only what it needs."""

    def __init__(
        self,
        run: _Run,
        readings: DataFrame,
        stations: Sequence[str] | None = None,
        layout: Layout | None = None,
    ) -> None:
        self._run = run
        self._readings = readings
        self._asked = stations
        self._placed = readings.select(*run.columns(readings)).filter(run.placeable())
        self.layout = layout or Layout.of(self._placed, run.config.chunk, run.series)
        self._buckets = run.buckets(self._placed, self.layout)

    @property
    def resampled(self) -> DataFrame:
        """Clean readings on the bucket grid."""
        run = self._run
        rows = self._buckets.filter(F.col("kept") > 0).select(*run.series, "timestamp", *run.sensors)
        return fill_grid(rows, run.config.resample_rule, run.series) if run.config.fill_grid else rows

    @cached_property
    def _devices(self) -> DataFrame:
        if self._run.by_segments:
            return self._run.devices_by_segments(self._buckets)
        # In slices the buckets are not yet together by device; whole series already are.
        together = self._buckets.repartition(*self._run.series) if self.layout.sliced else self._buckets
        return self._run.devices(together)

    @property
    def devices(self) -> DataFrame:
        """One row of metrics per device."""
        return self._devices.filter(F.col("reading_count") > 0).select(*self._run.series, *METRICS)

    @cached_property
    def _stations(self) -> DataFrame:
        run = self._run
        stations = run.stations(self._devices, run.outside(self._readings))
        if not self.layout.sliced:
            return stations
        checked = run.checked(self.layout.spread(self._placed))
        hints = flatline_counts(checked, run.contract, self.layout, run.by)
        stations = stations.drop("flat_pre").join(hints, on=list(run.by), how="left")
        return stations.withColumn("flat_pre", F.expr("coalesce(flatline_periods, 0)"))

    @property
    def quality(self) -> DataFrame:
        """Flat data-quality report, one row per station."""
        return self._run.report(self._stations)

    @property
    def results(self) -> DataFrame:
        """Nested result per station, as stored in snapshots; rows without station are in no result."""
        results = self._run.documents(self._stations.filter(self._run.has_group()))
        return results if self._asked is None else self._run.with_stations(results, self._asked)

    def results_for(self, groups: DataFrame) -> DataFrame:
        """Nested results of these groups only; one without rows gets the empty report."""
        return self._run.with_groups(self.results, groups)


def run_pipeline(
    readings: DataFrame,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
    by: Sequence[str] = ("station_id",),
    stations: Sequence[str] | None = None,
    layout: Layout | None = None,
) -> StationRun:
    """Plan the whole run for every group of ``by`` columns (a station, or a station and period).

    ``stations`` names stations that must appear in the results even when they have no rows.
    ``layout`` saves the measuring pass when the caller knows how to slice the series.
    """
    zone = readings.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in UTC:
        raise ValueError(f"days and ISO texts are in UTC: set spark.sql.session.timeZone to UTC, not {zone}")
    return StationRun(_Run(contract, config, tuple(by)), readings, stations, layout)


def process(
    spark: SparkSession,
    readings: DataFrame,
    path: str,
    contract: Contract,
    config: PipelineConfig = PipelineConfig(),
    stations: Sequence[str] | None = None,
    by: Sequence[str] = ("station_id",),
) -> DataFrame:
    """Run, store the snapshots, and return one receipt per station."""
    run = run_pipeline(readings, contract, config, by, stations)
    started = datetime.now(timezone.utc)
    return receipts(spark, path, write_snapshots(run.results, path), started)


@dataclass(frozen=True)
class _Run:
    contract: Contract
    config: PipelineConfig
    by: tuple[str, ...]

    @property
    def series(self) -> tuple[str, ...]:
        return (*self.by, DEVICE_ID)

    @property
    def sensors(self) -> tuple[str, ...]:
        return self.contract.sensors

    # -- raw rows ------------------------------------------------------------------------

    def columns(self, readings: DataFrame) -> list[str]:
        """Columns of the run; the event id rides along because it orders equal timestamps."""
        extra = ["event_id"] if "event_id" in readings.columns else []
        return [*dict.fromkeys([*self.series, "timestamp", *extra, *self.sensors])]

    def outside(self, readings: DataFrame) -> DataFrame:
        """Counts of the rows that belong to no device series.

        Rows without station (or period) get a report row of their own, under the NULL key.
        """
        rows = readings.filter(~self.placeable())
        return rows.groupBy(*self.by).agg(*self.raw_counts_direct())

    def placeable(self) -> Column:
        """Rows that belong to a device series."""
        known = F.col("timestamp").isNotNull() & F.col(DEVICE_ID).isNotNull()
        return known & self.has_group()

    def has_group(self) -> Column:
        known = F.lit(True)
        for c in self.by:
            known = known & F.col(c).isNotNull()
        return known

    def checked(self, rows: DataFrame) -> DataFrame:
        """Range-validated rows; one integer keeps what was out of range and what was missing."""
        bits = [self.contract.out_of_range_sql(s) for s in self.sensors]
        bits += [f"`{s}` IS NULL" for s in self.sensors]
        flags = " + ".join(f"CASE WHEN {b} THEN {1 << i}L ELSE 0L END" for i, b in enumerate(bits))
        return rows.withColumns({FLAGS: F.expr(flags), **{s: self.contract.in_range(s) for s in self.sensors}})

    def raw_counts(self) -> list[Column]:
        """Report counts over rows that carry flags."""
        n = len(self.sensors)
        marks = {"anomaly_rows": (1 << n) - 1}
        marks |= {f"oor_{s}": 1 << i for i, s in enumerate(self.sensors)}
        marks |= {f"null_{s}": 1 << (n + i) for i, s in enumerate(self.sensors)}
        return [
            F.expr("count(1) AS rows_before"),
            *[F.expr(f"count(CASE WHEN {FLAGS} & {m}L != 0 THEN 1 END) AS {name}") for name, m in marks.items()],
        ]

    def raw_counts_direct(self) -> list[Column]:
        """The same counts for the few rows outside any series, which skip the shuffle."""
        return [
            F.count(F.lit(1)).alias("rows_before"),
            count_if(self.contract.any_out_of_range()).alias("anomaly_rows"),
            *[count_if(self.contract.out_of_range(s)).alias(f"oor_{s}") for s in self.sensors],
            *[count_if(F.col(s).isNull()).alias(f"null_{s}") for s in self.sensors],
            count_if(F.col("timestamp").isNull()).alias("null_timestamp"),
            count_if(F.col(DEVICE_ID).isNull()).alias("null_device_id"),
            count_if(F.col("station_id").isNull()).alias("null_station_id"),
        ]

    @property
    def count_names(self) -> list[str]:
        per_sensor = [f"{kind}_{s}" for kind in ("oor", "null") for s in self.sensors]
        return ["rows_before", "anomaly_rows", *per_sensor]

    # -- buckets -------------------------------------------------------------------------

    def buckets(self, placed: DataFrame, layout: Layout) -> DataFrame:
        """Means per device and bucket, next to the raw counts of the bucket.

        A bucket whose rows were all dropped stays as a carrier of counts (``kept = 0``).
        """
        rows = layout.spread(placed) if layout.sliced else layout.sliced_rows(placed)
        rows = self.checked(rows)
        if not layout.sliced:
            rows = flatlines_ending_here(rows, self.contract.flatline_minutes, layout.forward())
        kept = "true"
        if self.config.strategy is MissingData.DROP:
            kept = " AND ".join(f"`{s}` IS NOT NULL" for s in self.sensors)
        else:
            rows = impute(
                rows,
                self.config.strategy,
                self.sensors,
                layout,
                self.config.fill_values,
                self.config.interpolate_by,
            )
        rule = parse_rule(self.config.resample_rule)
        # Grouping by the slice as well changes nothing when buckets nest in slices, and lets the
        # aggregate use the rows where they are.
        inside = layout.slice_columns if layout.nests(rule) else ()
        flat = [] if layout.sliced else [F.sum("_flat").alias("flat_pre")]
        return rows.groupBy(*self.series, *inside, time_bucket("timestamp", rule).alias("_bucket")).agg(
            *[F.expr(f"avg(CASE WHEN {kept} THEN `{s}` END) AS `{s}`") for s in self.sensors],
            F.expr(f"count(CASE WHEN {kept} THEN 1 END) AS kept"),
            *self.raw_counts(),
            *flat,
        ).withColumnRenamed("_bucket", "timestamp")

    # -- devices -------------------------------------------------------------------------

    def devices(self, buckets: DataFrame) -> DataFrame:
        """Metrics and summed counts per device.

        Whole-device windows are safe here: a device has at most one row per bucket, so its
        length is set by the calendar, not by the data volume.
        """
        real = F.col("kept") > 0
        rows = buckets.withColumn("_real", real).withColumn(TIE, F.lit(0))
        if self.config.fill_grid:
            rows = self._on_grid(rows)
        window = Window.partitionBy(*self.series, "_real").orderBy("timestamp")
        previous = {f"prev_{n}": F.lag(v).over(window) for n, v in previous_values(self.config).items()}
        rows = rows.withColumns(previous)
        rows = flatlines_ending_here(rows, self.contract.flatline_minutes, window)
        flat_pre = F.sum("flat_pre") if "flat_pre" in buckets.columns else F.lit(0).cast("long")
        when_real = F.when(F.col("_real"), F.col("timestamp"))
        return rows.groupBy(*self.series).agg(
            *[c.alias(n) for n, c in metric_aggregates(self.config, "_real").items()],
            *[F.expr(f"count(CASE WHEN _real AND `{s}` IS NULL THEN 1 END) AS after_{s}") for s in self.sensors],
            F.sum("_flat").alias("flat_post"),
            flat_pre.alias("flat_pre"),
            F.min(when_real).alias("first_bucket"),
            F.max(when_real).alias("last_bucket"),
            *[F.sum(n).alias(n) for n in self.count_names],
        )

    @property
    def by_segments(self) -> bool:
        """Below a minute the calendar allows too many buckets for one window over a device."""
        width = parse_rule(self.config.resample_rule).width_us
        return bool(width) and width < MINUTE and not self.config.fill_grid

    def devices_by_segments(self, buckets: DataFrame) -> DataFrame:
        """The same as :meth:`devices`, from summaries of time segments."""
        layout = Layout(self.series, segment_width(parse_rule(self.config.resample_rule)))
        real = F.col("kept") > 0
        after = {f"after_{s}": F.when(real & F.col(s).isNull(), 1).otherwise(0) for s in self.sensors}
        flat_pre = F.col("flat_pre") if "flat_pre" in buckets.columns else F.lit(0).cast("long")
        rows = layout.spread(buckets.withColumns({**after, "flat_pre": flat_pre}))
        sums = (*after, "flat_pre", *self.count_names)
        whole = combine_all(
            summaries(rows, self.config, layout, "kept > 0", sums), self.series, self.config, layout.slice_us, sums
        )
        edges = [F.col(f"{end}.timestamp").alias(f"{end}_bucket") for end in ("first", "last")]
        devices = metrics_of(whole, self.series, [*sums, *edges])
        flats = flatline_counts(rows.filter(real), self.contract, layout, self.series)
        devices = devices.join(flats.withColumnRenamed("flatline_periods", "flat_post"), list(self.series), "left")
        return devices.withColumn("flat_post", F.coalesce("flat_post", F.lit(0).cast("long")))

    def _on_grid(self, rows: DataFrame) -> DataFrame:
        """Empty buckets become rows without values, for runs that want a uniform grid."""
        real = rows.filter("_real")
        grid = fill_grid(real, self.config.resample_rule, self.series)
        counts = [c for c in rows.columns if c not in (*self.series, "timestamp", *self.sensors, "_real", TIE)]
        grid = grid.withColumns(
            {"_real": F.lit(True), TIE: F.lit(0), **{c: F.coalesce(c, F.lit(0)) for c in counts}}
        )
        return grid.unionByName(rows.filter(~F.col("_real")))

    # -- stations ------------------------------------------------------------------------

    def stations(self, devices: DataFrame, lost: DataFrame) -> DataFrame:
        """One row per group: summed counts, window, and its devices in order of their id."""
        # The small branch first: see the note on unions in ``impute``.
        rows = lost.unionByName(devices, allowMissingColumns=True)
        entry = F.struct(F.col(DEVICE_ID).alias("device_id"), F.struct(*METRICS).alias("metrics"))
        summed = [
            *self.count_names,
            "null_timestamp",
            "null_device_id",
            "null_station_id",
            "flat_pre",
            "flat_post",
            "reading_count",
            *[f"after_{s}" for s in self.sensors],
        ]
        # One small entry per device, never per reading.
        entries = F.collect_list(F.when(F.col("reading_count") > 0, entry))
        return rows.groupBy(*self.by).agg(
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in summed],
            F.min("first_bucket").alias("window_start_ts"),
            F.max("last_bucket").alias("window_end_ts"),
            F.array_sort(entries).cast(_device_array()).alias("devices"),
        )

    def shares_after(self) -> dict[str, str]:
        """Missing share per sensor after resampling, 0 when nothing is left."""
        return {s: f"coalesce(try_divide(double(after_{s}), reading_count), 0D)" for s in self.sensors}

    def shares_before(self) -> dict[str, str]:
        ids = {"timestamp": "null_timestamp", "station_id": "null_station_id", DEVICE_ID: "null_device_id"}
        counts = ids | {s: f"null_{s}" for s in self.sensors}
        return {c: f"try_divide(double({n}), rows_before)" for c, n in counts.items()}

    def score(self) -> Column:
        cells = " + ".join(f"oor_{s}" for s in self.sensors)
        return score(list(self.shares_after().values()), cells, "rows_before")

    def report(self, stations: DataFrame) -> DataFrame:
        """Flat data-quality report, one row per group."""
        return stations.select(
            *self.by,
            "rows_before",
            F.col("reading_count").alias("rows_after"),
            "anomaly_rows",
            "flat_pre",
            "flat_post",
            *[F.col(f"oor_{s}") for s in self.sensors],
            *[F.expr(f"{c} AS missing_before_{n}") for n, c in self.shares_before().items()],
            *[F.expr(f"{c} AS missing_after_{n}") for n, c in self.shares_after().items()],
            self.score().alias("data_quality_score"),
        )

    def documents(self, stations: DataFrame) -> DataFrame:
        """Nested result per group, as stored in snapshots."""
        start, end = iso_text(F.col("window_start_ts")), iso_text(F.col("window_end_ts"))
        extra = F.struct(
            _map(self.shares_before()).alias("missing_fraction_before_clean"),
            F.col("flat_pre").alias("flatline_periods_pre_clean_hint"),
            F.lit(self.config.resample_rule).alias("resample_rule"),
            F.lit(self.config.strategy.value).alias("missing_strategy"),
            F.lit(None).cast("string").alias("note"),
        )
        quality = F.struct(
            _map(self.shares_after()).alias("missing_fraction_by_column"),
            _map({s: f"oor_{s}" for s in self.sensors}).alias("out_of_range_count_by_column"),
            F.col("flat_post").alias("flatline_periods_count"),
            F.col("rows_before").alias("rows_before_clean"),
            F.col("reading_count").alias("rows_after_clean"),
            F.col("anomaly_rows").alias("anomaly_rows_pre_clean"),
            extra.alias("extra"),
        )
        # An emptied group has no rows to report on in its extras.
        extras = F.struct(
            F.when(F.col("reading_count") > 0, F.col("reading_count")).alias("rows_processed"),
            self.score().alias("data_quality_score"),
        )
        metrics = F.struct(
            F.col("station_id"),
            start.alias("window_start"),
            end.alias("window_end"),
            F.col("devices"),
            extras.alias("extras"),
        )
        return stations.select(
            *self.by,
            start.alias("window_start"),
            end.alias("window_end"),
            "window_start_ts",
            "window_end_ts",
            self.score().alias("data_quality_score"),
            quality.cast(QUALITY).alias("data_quality"),
            metrics.cast(RESULT).alias("metrics"),
        )

    def with_stations(self, results: DataFrame, stations: Sequence[str]) -> DataFrame:
        """Requested stations only; one without rows gets the empty report and score 0."""
        spark = results.sparkSession
        asked = spark.createDataFrame([(s,) for s in dict.fromkeys(stations)], "station_id string")
        return self.with_groups(results, asked, on=("station_id",))

    def with_groups(self, results: DataFrame, asked: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
        """Results of the groups asked for; one without rows gets the empty report and score 0."""
        rows = asked.join(results, on=list(on or self.by), how="left")
        no_map = F.create_map().cast("map<string,double>")
        zero = F.lit(0)
        quality = F.struct(
            no_map, F.create_map().cast("map<string,bigint>"), zero, zero, zero, zero,
            F.struct(
                F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit("nothing was read for this station and window")
            ),
        ).cast(QUALITY)
        metrics = F.struct(
            F.col("station_id"), F.lit(""), F.lit(""), F.array().cast(_device_array()),
            F.struct(F.lit(None), F.lit(None)),
        ).cast(RESULT)
        absent = F.col("data_quality").isNull()
        return rows.withColumns(
            {
                "window_start": F.coalesce("window_start", F.lit("")),
                "window_end": F.coalesce("window_end", F.lit("")),
                "data_quality_score": F.coalesce("data_quality_score", F.lit(0.0)),
                "data_quality": F.when(absent, quality).otherwise(F.col("data_quality")),
                "metrics": F.when(absent, metrics).otherwise(F.col("metrics")),
            }
        )


def _map(values: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(f'{name!r}, {value}' for name, value in values.items())})")


def _device_array() -> str:
    return f"array<{DEVICE.simpleString()}>"
