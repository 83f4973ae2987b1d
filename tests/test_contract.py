import json

import pytest
from pyspark.sql import functions as F

from airmetrics.config import MissingData, PipelineConfig
from airmetrics.contract import Contract
from airmetrics.functions.time import parse_bound, parse_rule, time_bucket
from airmetrics.operators.evolve import (
    contract_checks,
    convert_units,
    missing_columns,
    normalise_types,
    rename_aliases,
    select_known,
    type_problems,
)


def test_built_in_contract():
    c = Contract.compressed_air()
    assert c.sensors[0] == "discharge_pressure" and len(c.sensors) == 5
    assert c.flatline_minutes["discharge_pressure"] == 30
    assert c.spec("discharge_temp").valid_range == (-10.0, 120.0)
    assert c.required == ("timestamp", "station_id", "device_id")
    assert c.typical_ranges["motor_speed"] == (800.0, 3600.0)


def test_contract_file_drives_everything(tmp_path, spark):
    doc = {
        "version": "2.0.0",
        "tables": {
            "sensor_readings": {
                "columns": {
                    "timestamp": {"type": "datetime", "required": True},
                    "station_id": {"type": "string", "required": True},
                    "device_id": {"type": "string", "required": True},
                    "oil_level": {"type": "float", "unit": "l", "valid_range": {"min": 1, "max": 9}},
                    "starts": {"type": "integer"},
                }
            }
        },
        "sensor_types": {"oil_level": {"flatline_threshold_minutes": 15}, "other": {"category": "x"}},
    }
    path = tmp_path / "contract.json"
    path.write_text(json.dumps(doc), encoding="utf-8")
    c = Contract.from_json(path)
    assert c.sensors == ("oil_level", "starts")
    assert c.flatline_minutes == {"oil_level": 15}
    assert c.struct_type()["starts"].dataType.simpleString() == "double"
    df = spark.createDataFrame([(0.5,), (1.0,), (9.0,), (9.1,), (None,)], "oil_level double")
    bad = [r[0] for r in df.select(c.out_of_range("oil_level")).collect()]
    assert bad == [True, False, False, True, False]


def test_missing_contract_file():
    with pytest.raises(FileNotFoundError):
        Contract.from_json("/no/such/contract.json")


@pytest.mark.parametrize(
    ("text", "us", "months"),
    [("5min", 300_000_000, 0), ("5m", 300_000_000, 0), ("1h", 3_600_000_000, 0), ("1d12h", 129_600_000_000, 0),
     ("250ms", 250_000, 0), ("1w", 604_800_000_000, 0), ("1q", 0, 3), ("2mo", 0, 2), ("1y", 0, 12)],
)
def test_rules(text, us, months):
    rule = parse_rule(text)
    assert (rule.width_us, rule.months) == (us, months)


@pytest.mark.parametrize("text", ["", "min", "5x", "1h1mo", "0h"])
def test_bad_rules(text):
    with pytest.raises(ValueError):
        parse_rule(text)


def test_bucket_starts(spark):
    df = spark.createDataFrame([("2024-05-15 13:47:12",)], "t string").select(F.to_timestamp("t").alias("t"))
    starts = {r: df.select(time_bucket("t", r).cast("string")).first()[0] for r in
              ("5min", "1h", "1d", "1w", "1mo", "1q", "1y", "2mo")}
    assert starts == {
        "5min": "2024-05-15 13:45:00",
        "1h": "2024-05-15 13:00:00",
        "1d": "2024-05-15 00:00:00",
        "1w": "2024-05-13 00:00:00",
        "1mo": "2024-05-01 00:00:00",
        "1q": "2024-04-01 00:00:00",
        "1y": "2024-01-01 00:00:00",
        "2mo": "2024-05-01 00:00:00",
    }


def test_window_bounds():
    assert parse_bound("") is None and parse_bound(None) is None
    assert parse_bound("2024-01-01T00:00:00Z") == parse_bound("2024-01-01T01:00:00+01:00")
    with pytest.raises(ValueError, match="invalid datetime"):
        parse_bound("not-a-date")


def test_strategy_names():
    assert PipelineConfig(missing_strategy="ffill").strategy is MissingData.FFILL
    with pytest.raises(ValueError):
        PipelineConfig(missing_strategy="guess").strategy
    assert PipelineConfig(missing_strategy="guess", strict=False).strategy is MissingData.INTERPOLATE


def test_evolution(spark, contract):
    old = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", "s", "d", 700.0, "12.5", 3.0, 1500, 104.0, "x"),
         ("garbage", "s", None, 800.0, "n/a", 3.0, 1500, 32.0, "y")],
        "timestamp string, station_id string, device_id string, pressure_bar double, flow_m3h string, "
        "power_kw double, rpm int, temperature_c double, note string",
    )
    assert {p["column"] for p in type_problems(old, contract)} >= {"discharge_pressure", "timestamp"}
    assert "air_flow_rate" in missing_columns(old, contract)
    with pytest.raises(ValueError, match="note"):
        select_known(rename_aliases(old), contract, strict=True)
    known = select_known(rename_aliases(old), contract)
    checks = {r["column"]: (r.invalid, r.required_missing) for r in contract_checks(known, contract).collect()}
    assert checks["timestamp"] == (1, 0)
    assert checks["air_flow_rate"] == (1, 0)
    assert checks["device_id"] == (0, 1)
    rows = convert_units(
        normalise_types(known, contract), contract, {"discharge_pressure": "kPa", "discharge_temp": "°F"}
    ).collect()
    assert rows[0].discharge_pressure == pytest.approx(7.0)
    assert rows[0].discharge_temp == pytest.approx(40.0) and rows[1].discharge_temp == pytest.approx(0.0)
    assert rows[1].air_flow_rate is None and rows[1].timestamp is None
    with pytest.raises(ValueError, match="no conversion"):
        convert_units(known, contract, {"motor_speed": "knots"})
