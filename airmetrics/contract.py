"""The readings contract: column types, valid ranges and sensor limits.

A contract lives on the driver and only produces expressions, so every rule it holds ends up
inside the query plan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics import compressed_air as fixed

ID_COLUMNS = ("timestamp", "station_id", "device_id")
SERIES = ("station_id", "device_id")

SPARK_TYPES: dict[str, T.DataType] = {
    "datetime": T.TimestampType(),
    "date": T.DateType(),
    "string": T.StringType(),
    "float": T.DoubleType(),
    "integer": T.LongType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str
    required: bool = False
    valid_range: tuple[float, float] | None = None
    unit: str | None = None

    def spark_type(self) -> T.DataType:
        if self.dtype not in SPARK_TYPES:
            raise ValueError(f"column {self.name!r} has unknown type {self.dtype!r}")
        return SPARK_TYPES[self.dtype]


@dataclass(frozen=True)
class SensorLimits:
    category: str | None = None
    typical_range: tuple[float, float] | None = None
    flatline_minutes: int | None = None


@dataclass(frozen=True)
class Contract:
    """Column specs of the readings and station tables, plus the limits of each sensor."""

    version: str
    columns: tuple[ColumnSpec, ...]
    station_columns: tuple[ColumnSpec, ...]
    limits: dict[str, SensorLimits]

    @classmethod
    def from_json(cls, path: str | Path) -> Contract:
        """Read a contract file; a missing file raises ``FileNotFoundError``."""
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_dict(cls, doc: dict[str, Any]) -> Contract:
        tables = doc.get("tables", {})

        def specs(table: str) -> tuple[ColumnSpec, ...]:
            declared = tables.get(table, {}).get("columns", {})
            return tuple(
                ColumnSpec(
                    name,
                    str(spec.get("type", "string")),
                    bool(spec.get("required", False)),
                    _span(spec.get("valid_range")),
                    spec.get("unit"),
                )
                for name, spec in declared.items()
            )

        limits = {
            name: SensorLimits(
                spec.get("category"),
                _span(spec.get("typical_operating_range")),
                None
                if spec.get("flatline_threshold_minutes") is None
                else int(spec["flatline_threshold_minutes"]),
            )
            for name, spec in doc.get("sensor_types", {}).items()
        }
        return cls(str(doc.get("version", "")), specs("sensor_readings"), specs("station_metadata"), limits)

    @classmethod
    def compressed_air(cls) -> Contract:
        """The built-in compressed-air contract."""
        ids = tuple(ColumnSpec(n, t, required=True) for n, t in fixed.READING_IDS.items())
        sensors = tuple(
            ColumnSpec(n, dtype, False, (float(lo), float(hi)), unit)
            for n, (dtype, unit, lo, hi, *_) in fixed.SENSORS.items()
        )
        stations = tuple(
            ColumnSpec(n, t, True, fixed.NUM_COMPRESSORS_RANGE if n == "num_compressors" else None)
            for n, t in fixed.STATION_COLUMNS.items()
        )
        limits = {
            n: SensorLimits(category, (float(lo), float(hi)), minutes)
            for n, (_, _, _, _, lo, hi, minutes, category) in fixed.SENSORS.items()
        }
        return cls(fixed.CONTRACT_VERSION, ids + sensors, stations, limits)

    # -- what the contract declares ------------------------------------------------------

    def spec(self, name: str) -> ColumnSpec:
        for column in self.columns:
            if column.name == name:
                return column
        raise KeyError(name)

    @property
    def sensors(self) -> tuple[str, ...]:
        """Numeric measurement columns, in declared order."""
        return tuple(
            c.name for c in self.columns if c.dtype in ("float", "integer") and c.name not in ID_COLUMNS
        )

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.required)

    @property
    def flatline_minutes(self) -> dict[str, int]:
        """Flatline threshold of every sensor that has one."""
        return {
            s: self.limits[s].flatline_minutes
            for s in self.sensors
            if s in self.limits and self.limits[s].flatline_minutes is not None
        }

    @property
    def typical_ranges(self) -> dict[str, tuple[float, float]]:
        return {
            s: self.limits[s].typical_range
            for s in self.sensors
            if s in self.limits and self.limits[s].typical_range is not None
        }

    def struct_type(self) -> T.StructType:
        """Schema of a readings frame: sensors are doubles whatever the declared number type."""
        return T.StructType(
            [
                T.StructField(
                    c.name,
                    T.DoubleType() if c.name in self.sensors else c.spark_type(),
                    True,
                    {
                        "unit": c.unit or "",
                        "required": c.required,
                        **({"min": c.valid_range[0], "max": c.valid_range[1]} if c.valid_range else {}),
                    },
                )
                for c in self.columns
            ]
        )

    def station_struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type()) for c in self.station_columns])

    # -- what the contract says about a row ----------------------------------------------

    def out_of_range_sql(self, name: str) -> str:
        """True when the value is present and outside its inclusive range (NaN is above it)."""
        span = self.spec(name).valid_range
        if span is None:
            return "false"
        return f"coalesce(`{name}` < {span[0]}D OR `{name}` > {span[1]}D, false)"

    def out_of_range(self, name: str) -> Column:
        return F.expr(self.out_of_range_sql(name))

    def any_out_of_range(self) -> Column:
        return F.expr(" OR ".join(self.out_of_range_sql(s) for s in self.sensors))

    def in_range(self, name: str) -> Column:
        """The value, or NULL when it is out of range."""
        return F.expr(f"CASE WHEN NOT {self.out_of_range_sql(name)} THEN `{name}` END").alias(name)


def _span(doc: dict[str, Any] | None) -> tuple[float, float] | None:
    return None if doc is None else (float(doc["min"]), float(doc["max"]))
