"""Sensor time-series analytics on Spark."""

from airmetrics.config import MissingData, PipelineConfig
from airmetrics.contract import Contract
from airmetrics.plans.files import process_files, process_files_with_lookback
from airmetrics.plans.lookback import process_with_lookback, totals
from airmetrics.plans.stations import StationRun, process, run_pipeline
from airmetrics.sources.readings import ReadingSource, read_readings
from airmetrics.sources.snapshots import read_snapshots, write_snapshots
from airmetrics.streaming.consumer import start_stream

__all__ = [
    "Contract",
    "MissingData",
    "PipelineConfig",
    "ReadingSource",
    "StationRun",
    "process",
    "process_files",
    "process_files_with_lookback",
    "process_with_lookback",
    "read_readings",
    "read_snapshots",
    "run_pipeline",
    "start_stream",
    "totals",
    "write_snapshots",
]
