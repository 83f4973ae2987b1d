"""Runs of equal consecutive values.

Inside a slice a run is found with lag, lead and one running value on a single sort. Only runs
that are long enough, or that touch the edge of their slice, leave the slice; those few rows are
then stitched together per device.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from airmetrics.contract import SERIES, Contract
from airmetrics.functions.time import MINUTE, minutes_between
from airmetrics.operators.series import POS, TIE, Layout


def flatlines_ending_here(df: DataFrame, minutes: dict[str, int], window: WindowSpec) -> DataFrame:
    """Add ``_flat``: how many sensors' flatlines end on this row (whole-series windows)."""
    found = " + ".join(
        f"int(_end{i} AND NOT _begin{i} AND {_lasts(f'_since{i}', 'timestamp', m)})"
        for i, m in enumerate(minutes.values())
    )
    rows = _mark_runs(df, [_comparable(s) for s in minutes], window)
    return rows.withColumn("_flat", F.expr(found or "0")).select(*df.columns, "_flat")


def value_runs(
    df: DataFrame, series: dict[str, str], minutes: dict[str, int], layout: Layout = Layout()
) -> DataFrame:
    """Every run of at least two equal values that lasts its threshold, one row per run.

    ``series`` names the SQL expressions to scan. A NULL breaks a run, a time gap does not.
    Columns: keys, ``sensor``, ``value``, ``start``, ``end``, ``minutes``, ``readings``.
    """
    df = layout.split(df)[0]
    df = layout.spread(df) if layout.sliced else layout.sliced_rows(df)
    window = layout.forward()
    values = [F.expr(f"double({v}) AS _v{i}") for i, v in enumerate(series.values())]
    rows = df.select(*layout.partition, "timestamp", TIE, *values)
    rows = rows.withColumn(POS, F.row_number().over(window))
    rows = rows.withColumn("_final", F.lead(POS).over(window).isNull())
    rows = _mark_runs(rows, [f"_v{i}" for i in range(len(series))], window)
    opens = {f"_opens{i}": F.expr(f"_place{i} = 1") for i in range(len(series))}
    keep = {
        f"_keep{i}": F.expr(
            f"_end{i} AND (_opens{i} OR _final"
            f" OR (_v{i} IS NOT NULL AND {_lasts(f'_since{i}', 'timestamp', minutes[name])}))"
        )
        for i, name in enumerate(series)
    }
    # Most rows end no run worth keeping: drop them before anything is built for the others.
    rows = rows.withColumns(opens).withColumns(keep).filter(" OR ".join(keep))
    candidates = ", ".join(
        f"""CASE WHEN _keep{i} THEN named_struct('sensor', '{name}', 'value', _v{i},
            'start', _since{i}, 'end', timestamp, 'readings', bigint({POS} - _place{i} + 1),
            'opens', _opens{i}, 'closes', _final, 'place', _place{i},
            'threshold', {float(minutes[name])}D) END"""
        for i, name in enumerate(series)
    )
    runs = rows.select(*layout.partition, F.expr(f"explode(array({candidates})) AS r"))
    runs = runs.filter("r IS NOT NULL").select(*layout.partition, "r.*")
    if layout.sliced:
        runs = _stitch(runs, layout)
    long_enough = "value IS NOT NULL AND readings >= 2 AND " + _lasts("start", "end", "threshold")
    lasted = minutes_between(F.col("start"), F.col("end")).alias("minutes")
    return runs.filter(long_enough).select(
        *layout.keys, "sensor", "value", "start", "end", lasted, "readings"
    )


def _mark_runs(df: DataFrame, values: list[str], window: WindowSpec) -> DataFrame:
    """Per value: does a run begin here, does it end here, and since when does it last.

    A NULL is a run of its own.
    """
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = {
        f"_{name}{i}": F.expr(f"{name}({v})").over(window)
        for i, v in enumerate(values)
        for name in ("lag", "lead")
    }
    edges = {
        f"_{edge}{i}": F.expr(f"NOT coalesce(_{side}{i} = {v}, false)")
        for i, v in enumerate(values)
        for edge, side in (("begin", "lag"), ("end", "lead"))
    }
    marks = {"since": "timestamp"} | ({"place": POS} if POS in df.columns else {})
    begun = {
        f"_{name}{i}": F.expr(f"last(CASE WHEN _begin{i} THEN {what} END, true)").over(so_far)
        for i in range(len(values))
        for name, what in marks.items()
    }
    return df.withColumns(around).withColumns(edges).withColumns(begun)


def _lasts(start: str, end: str, minutes: object) -> str:
    """SQL: the time from start to end is at least that many minutes."""
    return f"(unix_micros(`{end}`) - unix_micros({start})) >= {minutes} * {MINUTE}D"


def _stitch(runs: DataFrame, layout: Layout) -> DataFrame:
    """Join the last run of a slice with the first run of the next when the value goes on."""
    order = Window.partitionBy(*layout.keys, "sensor").orderBy(*layout.slice_columns, "place")
    goes_on = F.lag("closes").over(order) & F.col("opens") & (F.lag("value").over(order) == F.col("value"))
    pieces = runs.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    pieces = pieces.withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return pieces.groupBy(*layout.keys, "sensor", "_run").agg(
        F.max("value").alias("value"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("readings").alias("readings"),
        F.max("threshold").alias("threshold"),
    )


def flatline_periods(df: DataFrame, contract: Contract, layout: Layout = Layout()) -> DataFrame:
    """List every flatline with an ``is_off`` mark for runs of zeros."""
    minutes = contract.flatline_minutes
    runs = value_runs(df, {s: _comparable(s) for s in minutes}, minutes, layout)
    return runs.withColumn("is_off", F.col("value") == 0)


def flatline_counts(
    df: DataFrame,
    contract: Contract,
    layout: Layout = Layout(),
    by: tuple[str, ...] = ("station_id",),
) -> DataFrame:
    """Flatlines summed over devices and sensors; groups without any are absent."""
    return flatline_periods(df, contract, layout).groupBy(*by).agg(
        F.count(F.lit(1)).alias("flatline_periods")
    )


def _comparable(column: str) -> str:
    """SQL: NaN breaks a run like NULL does."""
    return f"nanvl(`{column}`, NULL)"
