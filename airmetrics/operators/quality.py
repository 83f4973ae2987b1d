"""Data-quality counts, shares and the station score.

Everything here is a distributive aggregate: one pass, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airmetrics.contract import ID_COLUMNS, SERIES, Contract


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def range_counts(df: DataFrame, contract: Contract, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Out-of-range cells per sensor, and rows with at least one of them, on raw readings."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(contract.any_out_of_range()).alias("anomaly_rows"),
        *[count_if(contract.out_of_range(s)).alias(s) for s in contract.sensors],
    )


def missing_fractions(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("station_id",)
) -> DataFrame:
    """Share of NULLs per column; an empty group cannot occur, an empty frame gives no rows."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[missing_share(c).alias(_free(c, by)) for c in columns],
    )


def missing_share(column: str) -> Column:
    return F.avg(F.col(column).isNull().cast("double"))


def raw_missing_columns(contract: Contract) -> tuple[str, ...]:
    return (*ID_COLUMNS, *contract.sensors)


def missing_by_device(
    df: DataFrame, contract: Contract, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Missing percentage per device and column, one row each."""
    columns = ("timestamp", *contract.sensors)
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[missing_share(c).alias(c) for c in columns]
    )
    return unpivot(wide, [*keys, "rows"], columns, "column", "share").select(
        *keys, "column", "rows", (F.col("share") * 100).alias("missing_pct")
    )


def outside_typical(df: DataFrame, contract: Contract, keys: Sequence[str] = SERIES) -> DataFrame:
    """Share of valid values outside the typical operating range, per device and sensor."""

    def outside(s: str) -> Column:
        lo, hi = contract.typical_ranges[s]
        usable = F.col(s).isNotNull() & ~contract.out_of_range(s)
        return F.when(usable, ((F.col(s) < lo) | (F.col(s) > hi)).cast("double"))

    sensors = tuple(contract.typical_ranges)
    wide = df.groupBy(*keys).agg(
        *[F.struct(F.count(outside(s)).alias("n"), F.avg(outside(s)).alias("share")).alias(s) for s in sensors]
    )
    return unpivot(wide, list(keys), sensors, "sensor", "v").select(
        *keys, "sensor", F.col("v.n").alias("values"), F.col("v.share").alias("outside_share")
    )


def unpivot(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long, on frames that are already aggregated."""
    return df.unpivot(list(ids), list(columns), name, value)


def score(missing: Sequence[str], out_of_range_cells: str, rows: str) -> Column:
    """0..100: half the mean missing share after repair plus half the bad cells per raw row.

    Arguments are SQL expressions over one row.
    """
    mean_missing = f"({' + '.join(missing)}) / {len(missing)}"
    bad_rate = f"double({out_of_range_cells}) / greatest({rows}, 1)"
    return F.expr(f"round((1 - least(1D, {mean_missing} * 0.5D + {bad_rate} * 0.5D)) * 100, 2)")


def _free(column: str, by: Sequence[str]) -> str:
    """A group column cannot be repeated in its own output."""
    return f"{column}_missing" if column in by else column
