"""Bringing source tables onto the contract: names, units, types, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.compressed_air import COLUMN_ALIASES
from airmetrics.contract import Contract
from airmetrics.operators.quality import count_if, unpivot

# Fixed values: (factor, offset) from a source unit to the canonical one.
UNIT_CONVERSIONS = {
    ("psi", "bar"): (0.0689475729, 0.0),
    ("kPa", "bar"): (0.01, 0.0),
    ("MPa", "bar"): (10.0, 0.0),
    ("cfm", "m³/h"): (1.69901082, 0.0),
    ("m³/min", "m³/h"): (60.0, 0.0),
    ("l/s", "m³/h"): (3.6, 0.0),
    ("W", "kW"): (0.001, 0.0),
    ("hp", "kW"): (0.745699872, 0.0),
    ("Hz", "RPM"): (60.0, 0.0),
    ("°F", "°C"): (5.0 / 9.0, -160.0 / 9.0),
    ("K", "°C"): (1.0, -273.15),
}


def rename_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Old column names to contract names; a name already present wins over its alias."""
    known = COLUMN_ALIASES if aliases is None else aliases
    taken = set(df.columns)
    return df.withColumnsRenamed({a: c for a, c in known.items() if a in taken and c not in taken})


def convert_units(df: DataFrame, contract: Contract, units: dict[str, str]) -> DataFrame:
    """Convert columns delivered in other units; ``units`` names the delivered unit per column."""
    changed: dict[str, Column] = {}
    for name, unit in units.items():
        canonical = contract.spec(name).unit
        if unit == canonical:
            continue
        if (unit, canonical) not in UNIT_CONVERSIONS:
            raise ValueError(f"no conversion of {name!r} from {unit!r} to {canonical!r}")
        factor, offset = UNIT_CONVERSIONS[(unit, canonical)]
        changed[name] = F.col(name).cast("double") * factor + offset
    return df.withColumns(changed) if changed else df


def unknown_columns(df: DataFrame, contract: Contract, allowed: Sequence[str] = ("event_id",)) -> list[str]:
    declared = {c.name for c in contract.columns} | set(allowed)
    return [c for c in df.columns if c not in declared]


def select_known(
    df: DataFrame, contract: Contract, strict: bool = False, allowed: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Keep contract columns. Others are ignored, or an error in strict mode."""
    unknown = unknown_columns(df, contract, allowed)
    if strict and unknown:
        raise ValueError(f"columns not in the contract: {unknown}")
    return df.select(*[c for c in df.columns if c not in unknown])


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c.name for c in contract.columns if c.name not in df.columns]


def normalise_types(df: DataFrame, contract: Contract) -> DataFrame:
    """Cast to contract types; what cannot be cast becomes NULL instead of failing the job."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f for f in contract.struct_type().fields if have.get(f.name, f.dataType) != f.dataType]
    return df.withColumns({f.name: _cast(df, f.name, f.dataType) for f in wrong}) if wrong else df


def type_problems(df: DataFrame, contract: Contract) -> list[dict[str, str]]:
    """Driver-side schema check: absent columns, and columns that are not of the declared type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    found = []
    for column in contract.columns:
        have = actual.get(column.name)
        if have is None:
            found.append({"column": column.name, "problem": "absent", "found": ""})
        elif not _compatible(have, column.spark_type()):
            found.append({"column": column.name, "problem": "type", "found": have.simpleString()})
    return found


def contract_checks(df: DataFrame, contract: Contract, by: Sequence[str] = ()) -> DataFrame:
    """Per contract column: values that do not cast, and NULLs in required columns.

    One aggregate over the source, one output row per column (and group).
    """
    present = [c for c in contract.columns if c.name in df.columns]
    types = {f.name: f.dataType for f in contract.struct_type().fields}

    def checks(name: str, required: bool) -> Column:
        value = F.col(name)
        bad = value.isNotNull() & _cast(df, name, types[name]).isNull()
        return F.struct(
            count_if(bad).alias("invalid"),
            (count_if(value.isNull()) if required else F.lit(0).cast("long")).alias("required_missing"),
        )

    # A group column cannot be aggregated under its own name.
    named = {f"_{c.name}": c for c in present}
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[checks(c.name, c.required).alias(n) for n, c in named.items()]
    )
    return unpivot(wide, [*by, "rows"], list(named), "column", "v").select(
        *by,
        F.expr("substring(column, 2)").alias("column"),
        "rows",
        F.col("v.invalid").alias("invalid"),
        F.col("v.required_missing").alias("required_missing"),
    )


def _cast(df: DataFrame, name: str, to: T.DataType) -> Column:
    have = df.schema[name].dataType
    if have == to:
        return F.col(name)
    if isinstance(to, T.TimestampType) and isinstance(have, T.StringType):
        return F.try_to_timestamp(F.col(name))
    if isinstance(to, T.TimestampType) and isinstance(have, (T.TimestampNTZType, T.DateType)):
        return F.col(name).cast(to)
    return F.col(name).try_cast(to)


def _compatible(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(want, T.DoubleType):
        return isinstance(have, T.NumericType)
    if isinstance(want, T.LongType):
        return isinstance(have, (T.IntegralType, T.DoubleType))
    if isinstance(want, T.TimestampType):
        return isinstance(have, (T.TimestampType, T.TimestampNTZType))
    return have == want
