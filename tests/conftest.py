"""Shared session and small builders."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from airmetrics.contract import Contract  # noqa: E402

SENSORS = Contract.compressed_air().sensors
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("airmetrics-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def contract():
    return Contract.compressed_air()


@pytest.fixture
def frame(spark, contract):
    """Build readings from ``(minute, device, {sensor: value})``; other sensors are NULL."""

    def build(rows, station="s1", event_ids=True):
        data = []
        for i, (minute, device, values) in enumerate(rows):
            at = None if minute is None else T0 + timedelta(minutes=minute)
            sensors = [None if values.get(s) is None else float(values[s]) for s in SENSORS]
            data.append(((f"e{i:04d}",) if event_ids else ()) + (at, station, device, *sensors))
        columns = ", ".join(f"{s} double" for s in SENSORS)
        ids = "event_id string, " if event_ids else ""
        return spark.createDataFrame(
            data, f"{ids}timestamp timestamp, station_id string, device_id string, {columns}"
        )

    return build


@pytest.fixture
def unit_frame(frame):
    """A device with uneven steps, missing cells and an off sample, and one that only reports pressure."""
    minutes = (0, 20, 50, 60, 150, 180)
    pressure = (6.0, 8.0, None, 7.0, 9.0, 10.0)
    flow = (30.0, 60.0, 90.0, 0.0, None, 120.0)
    power = (15.0, 20.0, 45.0, 0.0, 10.0, 40.0)
    speed = (900.0, 900.0, 0.0, 0.0, 900.0, 900.0)
    temperature = (50.0, 60.0, 70.0, 20.0, 30.0, 80.0)
    cells = zip(pressure, flow, power, speed, temperature)
    rows = [(m, "d1", dict(zip(SENSORS, v))) for m, v in zip(minutes, cells)]
    return frame([*rows, (10, "d2", {SENSORS[0]: 5.0})])
