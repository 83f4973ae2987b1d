"""Stored partial sums against resampling the readings."""

import re
from datetime import datetime, timezone
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from airmetrics.operators.resample import resample
from airmetrics.operators.rollups import coarser, means, partials, tiles
from airmetrics.plans.rollups import best_level, drop_replaced, read_rollups, stored_levels, update_rollups
from airmetrics.sources.folders import shared_folder
from tests.conftest import SENSORS

P = SENSORS[0]
DAY = 24 * 60


def _cells(df):
    return sorted((r.station_id, str(r.device_id), r.timestamp, *[r[s] for s in SENSORS]) for r in df.collect())


@pytest.fixture
def rows(frame):
    """Three days: a null cell, an equal repeat, a value out of range, a row without time, one without device."""
    given = [
        (0, "d1", {P: 6.0}), (3, "d1", {P: 8.0}), (3, "d1", {P: 8.0}), (7, "d1", {}), (65, "d1", {P: 500.0}),
        (DAY - 1, "d1", {P: 7.0}), (DAY, "d1", {P: 9.0}), (2 * DAY + 30, "d2", {P: 5.0}), (None, "d1", {P: 1.0}),
        (40, None, {P: 4.0}),
    ]
    return frame(given)


def test_which_buckets_tile_which():
    for fine, coarse in (("5min", "1h"), ("1h", "1d"), ("1d", "1w"), ("1d", "1mo"), ("1mo", "1q"), ("15min", "1mo"), ("1w", "2w")):
        assert tiles(fine, coarse) and not (fine != coarse and tiles(coarse, fine))
    for fine, coarse in (("7min", "1h"), ("5h", "1d"), ("1w", "1mo"), ("2d", "1w"), ("1mo", "1d")):
        assert not tiles(fine, coarse)


def test_widest_level_that_fits_is_read():
    at = lambda *a: datetime(2024, 1, *a, tzinfo=timezone.utc)
    levels = ("5min", "1h", "1d")
    assert best_level(levels, "1w") == "1d" and best_level(levels, "1h") == "1h" and best_level(levels, "10min") == "5min"
    assert best_level(levels, "1w", at(3), at(9)) == "1d"
    assert best_level(levels, "1w", at(3, 6), at(9)) == "1h" and best_level(levels, "1w", at(3), at(9, 6, 35)) == "5min"
    for rule, low in (("7min", None), ("1d", at(3, 6, 1))):
        with pytest.raises(ValueError):
            best_level(levels, rule, low)


def test_coarser_partials_equal_partials_of_the_wider_rule(rows):
    steps = coarser(coarser(partials(rows, "5min", SENSORS), "1h", SENSORS), "1d", SENSORS)
    direct = partials(rows, "1d", SENSORS)
    assert sorted(map(str, steps.collect())) == sorted(map(str, direct.select(*steps.columns).collect()))
    assert _cells(means(direct, SENSORS)) == _cells(resample(rows, "1d", SENSORS))


def test_stored_levels_follow_the_readings(spark, rows, contract):
    path = shared_folder(spark, "rollups")
    clean = rows.withColumn(P, F.when(F.col(P) < 100, F.col(P)))
    assert update_rollups(spark, rows, path, contract).count() == 3
    assert sorted(stored_levels(spark, path)) == ["1d", "1h", "5min"]
    for rule in ("10min", "1h", "1d", "1w"):
        assert _cells(means(read_rollups(spark, path, rule, contract), SENSORS)) == _cells(resample(clean, rule, SENSORS))

    # Nothing changed: no day is run. A value is corrected and a day vanishes: two are.
    assert update_rollups(spark, rows, path, contract).count() == 0
    changed = clean.filter(F.col("timestamp") < "2024-01-03").withColumn(P, F.when(F.to_date("timestamp") == "2024-01-02", 1.5).otherwise(F.col(P)))
    changed = changed.unionByName(clean.filter("timestamp is null"))
    seen = rows.filter("timestamp < '2024-01-02'")
    update = seen.unionByName(changed.filter("timestamp >= '2024-01-02'"))
    assert {str(r.period) for r in update_rollups(spark, update, path, contract).collect()} == {"2024-01-02", "2024-01-03"}
    want = _cells(resample(changed, "1d", SENSORS))
    assert _cells(means(read_rollups(spark, path, "1d", contract), SENSORS)) == want
    # The old 2 and 3 January of each level go; what is read stays.
    assert drop_replaced(spark, path) == 6 and drop_replaced(spark, path) == 0
    assert _cells(means(read_rollups(spark, path, "1d", contract), SENSORS)) == want


def test_unfinished_runs_are_not_read(spark, rows, contract):
    path = shared_folder(spark, "rollups")
    update_rollups(spark, rows, path, contract, ("1h", "1d"))
    level = spark.read.parquet(f"{path}/levels/rule=1h")
    level.withColumn("run_id", F.lit("dead")).write.mode("append").partitionBy("period", "run_id").parquet(f"{path}/levels/rule=1h")
    assert read_rollups(spark, path, "1h", contract).agg(F.sum("rows")).first()[0] == 9
    with pytest.raises(ValueError):
        update_rollups(spark, rows, path, contract)
    with pytest.raises(ValueError):
        update_rollups(spark, rows, shared_folder(spark, "rollups"), contract, ("1h", "90min"))


def test_range_cuts_buckets_and_days_that_are_opened(spark, rows, contract):
    path = shared_folder(spark, "rollups")
    update_rollups(spark, rows, path, contract)
    found = read_rollups(spark, path, "1d", contract, ["s1"], "2024-01-01T01:00:00Z", "2024-01-02T00:00:00Z")
    assert [(r.device_id, r.rows, r[f"{P}_sum"]) for r in found.collect()] == [("d1", 2, 7.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    levels = {part for f in found.inputFiles() for part in unquote(f).split("/") if part.startswith("rule=")}
    assert levels == {"rule=1h"}
    assert re.search(r"PartitionFilters: \[[^\]]*period#\d+ >= 2024-01-01[^\]]*period#\d+ <= 2024-01-01", plan)


def test_no_readings(spark, rows, contract):
    path = shared_folder(spark, "rollups")
    assert update_rollups(spark, rows.limit(0), path, contract).count() == 0
    assert read_rollups(spark, path, "1d", contract).count() == 0
