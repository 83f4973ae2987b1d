"""Repair of missing sensor values, per device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from airmetrics.config import MissingData
from airmetrics.operators.series import POS, TIE, Layout


def impute(
    df: DataFrame,
    strategy: MissingData | str,
    sensors: Sequence[str],
    layout: Layout = Layout(),
    fill_values: dict[str, float] | None = None,
    by: str = "row",
    edges: DataFrame | None = None,
) -> DataFrame:
    """Apply one strategy to the sensor columns.

    ``edges`` holds what each slice gets from the slices around it, where that is known already
    (see :mod:`airmetrics.plans.lookback`); otherwise it is derived from the rows.
    """
    strategy = MissingData.parse(strategy)
    if strategy is MissingData.DROP:
        return drop_missing(df, sensors)
    if strategy is MissingData.FFILL:
        return forward_fill(df, sensors, layout, edges)
    if strategy is MissingData.FILL:
        return fill_constant(df, fill_values or {})
    return interpolate(df, sensors, layout, by, edges)


def drop_missing(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Remove rows with any missing sensor value (no shuffle)."""
    return df.dropna(how="any", subset=list(sensors))


def fill_constant(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace missing values by a constant per sensor (no shuffle)."""
    if not values:
        raise ValueError("filling needs a value for at least one sensor")
    return df.fillna(values)


def forward_fill(
    df: DataFrame, sensors: Sequence[str], layout: Layout = Layout(), edges: DataFrame | None = None
) -> DataFrame:
    """Carry the last known value forward; gaps at the start of a series stay."""
    wanted = df.columns
    df, rest = layout.split(df)
    rows = layout.spread(df) if layout.sliced else layout.sliced_rows(df)
    so_far = layout.forward().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in sensors})
    if layout.sliced:
        if edges is None:
            carried = [
                F.last(s, ignorenulls=True).over(layout.across()).alias(f"_carried_{s}") for s in sensors
            ]
            edges = layout.last_rows(filled).select(*layout.partition, *carried)
        filled = layout.carry(filled, edges)
        filled = filled.withColumns({s: F.coalesce(s, f"_carried_{s}") for s in sensors})
    return _whole(filled.select(*wanted), rest)


def interpolate(
    df: DataFrame,
    sensors: Sequence[str],
    layout: Layout = Layout(),
    by: str = "row",
    edges: DataFrame | None = None,
) -> DataFrame:
    """Linear interpolation between the known values around a gap.

    ``by="row"`` spaces the points evenly by row position; ``by="time"`` uses the timestamps.
    Gaps at either end of a series stay.
    """
    if by not in ("row", "time"):
        raise ValueError(f"interpolate by 'row' or 'time', not {by!r}")
    wanted = df.columns
    df, rest = layout.split(df)
    df = layout.spread(df) if layout.sliced else layout.sliced_rows(df)
    forward, backward = layout.forward(), layout.backward()
    at = F.unix_micros("timestamp") if by == "time" else F.row_number().over(forward).cast("long")
    df = df.withColumn(POS, at)

    def nearest(window: WindowSpec, side: str) -> dict[str, Column]:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {
            name: F.expr(f"last({value}, true)").over(frame)
            for s in sensors
            for name, value in ((f"_{side}_{s}", f"`{s}`"), (f"_{side}_at_{s}", _known(s)))
        }

    rows = df.withColumns(nearest(forward, "prev")).withColumns(nearest(backward, "next"))
    if layout.sliced:
        rows = layout.carry(rows, _interpolation_edges(df, sensors, layout, by) if edges is None else edges)
    return _whole(rows.withColumns({s: _line(s, layout.sliced) for s in sensors}).select(*wanted), rest)


def _known(s: str) -> str:
    return f"CASE WHEN `{s}` IS NOT NULL THEN {POS} END"


def _line(s: str, sliced: bool) -> Column:
    """The value on the straight line between the neighbours; they may lie in other slices."""
    here = f"{POS} + _before" if sliced else POS
    ends = {}
    for side in ("prev", "next"):
        value, at = f"`_{side}_{s}`", f"`_{side}_at_{s}`"
        if sliced:
            carried = f"`_carried_{side}_{s}`"
            value, at = f"coalesce({value}, {carried}.value)", f"coalesce({at} + _before, {carried}.at)"
        ends[side] = (value, at)
    (a, start), (b, stop) = ends["prev"], ends["next"]
    # Equal positions occur only by time, between readings that share a timestamp.
    step = f"coalesce(try_divide(double({here} - {start}), double({stop} - {start})), 0D)"
    return F.expr(f"coalesce(`{s}`, {a} + ({b} - {a}) * {step})")


def _interpolation_edges(
    df: DataFrame, sensors: Sequence[str], layout: Layout, by: str
) -> DataFrame:
    """Per slice: rows before it, and the nearest known point of each sensor on either side."""
    # Positions are unique, times are not.
    order = f"struct(timestamp, {TIE})" if by == "time" else POS
    ends = []
    for s in sensors:
        placed = f"CASE WHEN `{s}` IS NOT NULL THEN {order} END"
        for end, pick in (("first", "min"), ("last", "max")):
            ends.append(F.expr(f"{pick}({_known(s)}) AS `_{end}_at_{s}`"))
            ends.append(F.expr(f"{pick}_by(`{s}`, {placed}) AS `_{end}_{s}`"))
    edges = df.groupBy(*layout.partition).agg(F.expr("count(1) AS _rows"), *ends)
    before = F.lit(0) if by == "time" else F.coalesce(F.sum("_rows").over(layout.across()), F.lit(0))
    edges = edges.withColumn("_before", before)

    def point(end: str, s: str) -> str:
        struct = f"named_struct('at', `_{end}_at_{s}` + _before, 'value', `_{end}_{s}`)"
        return f"last(CASE WHEN `_{end}_at_{s}` IS NOT NULL THEN {struct} END, true)"

    prev = {f"_carried_prev_{s}": F.expr(point("last", s)).over(layout.across()) for s in sensors}
    after = {f"_carried_next_{s}": F.expr(point("first", s)).over(layout.across_back()) for s in sensors}
    edges = edges.withColumns(prev).withColumns(after)
    return edges.select(*layout.partition, "_before", *prev, *after)


def _whole(rows: DataFrame, rest: DataFrame | None) -> DataFrame:
    """Rows outside any series pass through unchanged.

    They come first: Spark keeps the first branch's column aliases, and the series rows must keep
    the same shape in all their branches for the shuffle to be reused.
    """
    return rows if rest is None else rest.select(*rows.columns).unionByName(rows)
