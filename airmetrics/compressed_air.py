"""The built-in contract for compressed-air stations."""

from __future__ import annotations

# Sensor limits of the compressed-air contract.
# name: (type, unit, valid min, valid max, typical min, typical max, flatline minutes, category)
SENSORS = {
    "discharge_pressure": ("float", "bar", 0.0, 16.0, 6.0, 13.0, 30, "mechanical"),
    "air_flow_rate": ("float", "m³/h", 0.0, 600.0, 10.0, 450.0, 30, "mechanical"),
    "power_consumption": ("float", "kW", 0.0, 350.0, 5.0, 280.0, 30, "electrical"),
    "motor_speed": ("integer", "RPM", 0, 4000, 800, 3600, 60, "mechanical"),
    "discharge_temp": ("float", "°C", -10.0, 120.0, 25.0, 95.0, 60, "thermal"),
}

# Identifying columns of a reading, and the station table.
READING_IDS = {"timestamp": "datetime", "station_id": "string", "device_id": "string"}
STATION_COLUMNS = {
    "station_id": "string",
    "station_name": "string",
    "location": "string",
    "commissioned_date": "date",
    "num_compressors": "integer",
}
NUM_COMPRESSORS_RANGE = (1, 10)
CONTRACT_VERSION = "1.0.0"

# Older column names still found in source tables.
COLUMN_ALIASES = {
    "pressure_bar": "discharge_pressure",
    "flow_m3h": "air_flow_rate",
    "power_kw": "power_consumption",
    "rpm": "motor_speed",
    "temperature_c": "discharge_temp",
}
