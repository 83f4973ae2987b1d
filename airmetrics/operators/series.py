"""Ordered work on device series, without one task per device.

Forward fill, interpolation, lags and runs need the rows of a device in time order. A window on
the device alone would put a busy device's whole history into one task, so a series can be cut
into time slices: windows run inside ``(device, slice)``, one small row per slice is carried from
slice to slice, and a join on the slice key brings the carried values back to the rows.  The
result is the same as with whole-device windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from airmetrics.contract import SERIES
from airmetrics.functions.time import DAY, HOUR, MINUTE, SECOND, Rule, floor_us, parse_rule

SLICE = "_slice"
SUB = "_sub"
TIE = "_tie"
POS = "_pos"

# Rows one task may hold in a sort: a few hundred MB of readings.
TARGET_ROWS = 4_000_000
# At one-microsecond slices, equal timestamps are split further by this many bits of the tie hash.
TIE_BITS = 12


@dataclass(frozen=True)
class Layout:
    """Series key plus the slice width (``None`` keeps every series whole)."""

    keys: tuple[str, ...] = SERIES
    slice_us: int | None = None
    tie_bits: int = 0

    @classmethod
    def of(
        cls,
        df: DataFrame,
        chunk: str | None,
        keys: tuple[str, ...] = SERIES,
        target_rows: int = TARGET_ROWS,
    ) -> Layout:
        """``None``: whole series; a rule such as ``"1d"``: fixed slices; ``"auto"``: measured."""
        if chunk is None:
            return cls(tuple(keys))
        if chunk == "auto":
            return measure_layout(df, keys, target_rows)
        width = parse_rule(chunk).width_us
        if not width:
            raise ValueError(f"slices need a fixed width: {chunk!r}")
        return cls(tuple(keys), width)

    @property
    def sliced(self) -> bool:
        return self.slice_us is not None

    @property
    def slice_columns(self) -> tuple[str, ...]:
        if not self.sliced:
            return ()
        return (SLICE, SUB) if self.tie_bits else (SLICE,)

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, *self.slice_columns)

    def nests(self, rule: Rule) -> bool:
        """True when each bucket of ``rule`` lies inside one slice."""
        return self.sliced and not self.tie_bits and rule.divides(self.slice_us)

    def sliced_rows(self, df: DataFrame) -> DataFrame:
        """Add the slice columns and the tie-breaker that makes the time order total.

        Rows with equal timestamps are ordered by a hash of ``event_id``, or of the whole row when
        there is none, so the order does not depend on the input's arrangement.
        """
        return self._with_tie(self._with_slice(df))

    def spread(self, df: DataFrame) -> DataFrame:
        """Like :meth:`sliced_rows`, with the rows already shuffled by series and slice.

        Plans that read the rows more than once start from this frame: the shuffle below it is the
        same in every branch, so Spark runs it once and reuses its files.  The tie-breaker is
        derived above the shuffle, which keeps the shuffled columns equal in all branches.
        """
        if TIE in df.columns:
            return df
        return self._with_tie(self._with_slice(df).repartition(*self.partition))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows that belong to a series, and those without key or time.

        The same in every layout, so that results do not depend on the size of a series. The
        second scan is an ``IS NULL`` filter, which Parquet answers from its statistics. Rows that
        already have their place (slice or tie-breaker) were split before: ``None``.
        """
        if SLICE in df.columns or TIE in df.columns:
            return df, None
        known = in_series(self.keys)
        return df.filter(known), df.filter(~known)

    def _with_slice(self, df: DataFrame) -> DataFrame:
        if not self.sliced or SLICE in df.columns:
            return df
        df = df.withColumn(SLICE, floor_us(F.col("timestamp"), self.slice_us))
        if self.tie_bits:
            sub = F.shiftright(F.xxhash64(*_tie_columns(df)), 64 - self.tie_bits)
            df = df.withColumn(SUB, sub)
        return df

    def _with_tie(self, df: DataFrame) -> DataFrame:
        return df if TIE in df.columns else df.withColumn(TIE, F.xxhash64(*_tie_columns(df)))

    def forward(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy("timestamp", TIE)

    def backward(self) -> WindowSpec:
        """Reverse order: a running frame from the end is linear, a frame to the end is not."""
        return Window.partitionBy(*self.partition).orderBy(F.desc("timestamp"), F.desc(TIE))

    def across(self) -> WindowSpec:
        """Slices before this one, for windows over one row per slice."""
        order = Window.partitionBy(*self.keys).orderBy(*self.slice_columns)
        return order.rowsBetween(Window.unboundedPreceding, -1)

    def across_back(self) -> WindowSpec:
        """Slices after this one."""
        order = [F.desc(c) for c in self.slice_columns]
        return (
            Window.partitionBy(*self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        )

    def last_rows(self, rows: DataFrame) -> DataFrame:
        """The last row of each slice."""
        final = F.lead(F.lit(1)).over(self.forward()).isNull()
        return rows.withColumn("_final", final).filter("_final").drop("_final")

    def carry(self, df: DataFrame, edges: DataFrame) -> DataFrame:
        """Join per-slice values back to the rows; both sides share the slice key.

        No hint: Spark broadcasts the edges only when their measured size allows it.
        """
        return df.join(edges, on=list(self.partition), how="left")


def in_series(keys: Sequence[str]) -> Column:
    """True for rows with a full key and a time."""
    known = F.col("timestamp").isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    return known


def series_columns(df: DataFrame, layout: Layout, values: Sequence[str] = ()) -> list[str]:
    """Key, time, the event id if there is one, and the wanted values."""
    extra = [c for c in ("event_id", TIE) if c in df.columns]
    return [*dict.fromkeys([*layout.keys, "timestamp", *extra, *values])]


def _tie_columns(df: DataFrame) -> list[str]:
    return ["event_id"] if "event_id" in df.columns else sorted(set(df.columns) - {SLICE, SUB})


def measure_layout(
    df: DataFrame, keys: tuple[str, ...] = SERIES, target_rows: int = TARGET_ROWS
) -> Layout:
    """Widest slices that keep every ``(series, slice)`` within ``target_rows``.

    Each pass is a map-side combined count over the key and time columns only, and returns three
    numbers. Most inputs need one pass; a device whose clock stands still may need two.
    """
    keys = tuple(keys)
    if (whole := _largest(df, keys, (DAY, HOUR))) is None:
        return Layout(keys)
    per_hour, per_day, per_series = whole
    if per_series <= target_rows:
        return Layout(keys)
    if per_day <= target_rows:
        return Layout(keys, DAY)
    if per_hour <= target_rows:
        return Layout(keys, HOUR)
    per_second, per_minute, _ = _largest(df, keys, (MINUTE, SECOND))
    if per_minute <= target_rows:
        return Layout(keys, MINUTE)
    if per_second <= target_rows:
        return Layout(keys, SECOND)
    return Layout(keys, 1, TIE_BITS)


def _largest(
    df: DataFrame, keys: tuple[str, ...], widths: tuple[int, int]
) -> tuple[int, int, int] | None:
    """Largest row count per (series, narrow slice), (series, wide slice) and series."""
    wide, narrow = widths
    start = F.col("n") - F.pmod(F.col("n"), F.lit(wide))
    row = (
        df.filter(in_series(keys))
        .groupBy(*keys, floor_us(F.col("timestamp"), narrow).alias("n"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(*keys, start.alias("w"))
        .agg(F.sum("rows").alias("rows"), F.max("rows").alias("narrow"))
        .groupBy(*keys)
        .agg(F.sum("rows").alias("rows"), F.max("rows").alias("wide"), F.max("narrow").alias("narrow"))
        .agg(F.max("narrow"), F.max("wide"), F.max("rows"))
        .first()
    )
    return None if row[0] is None else (row[0], row[1], row[2])


def with_previous(df: DataFrame, layout: Layout, values: dict[str, Column]) -> DataFrame:
    """Add ``prev_<name>``: each value on the row before, NULL on a series' first row.

    Give it only the columns that are used afterwards. In slices, the last row of each slice is
    carried to the next one as a whole, so both readers of the shuffled rows need the same columns.
    """
    names = [f"prev_{n}" for n in values]
    wanted = [*df.columns, *names]
    packed = F.struct(*[v.alias(n) for n, v in zip(names, values.values())])
    df, rest = layout.split(df)
    rows = layout.spread(df) if layout.sliced else layout.sliced_rows(df)
    before = rows.withColumn("_before", F.lag(packed).over(layout.forward()))
    if layout.sliced:
        whole = F.struct(packed.alias("_before"), *df.columns)
        edges = layout.last_rows(rows).select(
            *layout.partition, F.last(whole).over(layout.across()).alias("_carried")
        )
        before = layout.carry(before, edges)
        before = before.withColumn("_before", F.coalesce("_before", F.col("_carried")["_before"]))
    rows = before.withColumns({n: F.col("_before")[n] for n in names}).select(*wanted)
    if rest is None:
        return rows
    return rest.select(*df.columns, *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names]).unionByName(rows)
