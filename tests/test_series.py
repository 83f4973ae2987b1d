"""Series operators against plain Python, whole and in slices."""

import math
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airmetrics.functions.time import DAY, HOUR
from airmetrics.operators.flatlines import flatline_counts, flatline_periods, flatlines_ending_here
from airmetrics.operators.gaps import reading_gaps
from airmetrics.operators.impute import drop_missing, fill_constant, forward_fill, impute, interpolate
from airmetrics.operators.resample import fill_grid
from airmetrics.operators.series import SUB, Layout, measure_layout, with_previous
from tests.conftest import SENSORS

LAYOUTS = {
    "whole": Layout(),
    "day": Layout(slice_us=DAY),
    "hour": Layout(slice_us=HOUR),
    "ties": Layout(slice_us=1, tie_bits=12),
}
PRESSURE = "discharge_pressure"


def fill_python(values):
    last, out = None, []
    for v in values:
        last = v if v is not None else last
        out.append(last)
    return out


def line_python(values):
    known = [i for i, v in enumerate(values) if v is not None]
    out = list(values)
    for a, b in zip(known, known[1:]):
        for i in range(a + 1, b):
            out[i] = values[a] + (values[b] - values[a]) * (i - a) / (b - a)
    return out


def runs_python(minutes, values, threshold):
    found, i = [], 0
    while i < len(values):
        j = i + 1
        while values[i] is not None and j < len(values) and values[j] == values[i]:
            j += 1
        if j - i >= 2 and minutes[j - 1] - minutes[i] >= threshold:
            found.append((values[i], minutes[i], minutes[j - 1], j - i))
        i = j
    return found


def skewed_rows(seed=7, n=900):
    """One device holds most rows; gaps and runs cross slice edges."""
    rng = random.Random(seed)
    rows, minute, value = [], 0, 5.0
    for i in range(n):
        minute += rng.choice([1, 3, 11, 40])
        if rng.random() < 0.4:
            value = float(rng.randint(0, 3))
        missing = rng.random() < 0.45 or 300 < i < 420
        device = "hot" if rng.random() < 0.9 else rng.choice(["a", "b"])
        rows.append((minute, device, {PRESSURE: None if missing else value, "motor_speed": rng.choice([None, 0, 9])}))
    return rows


def by_device(rows):
    series = defaultdict(list)
    for minute, device, values in rows:
        series[device].append((minute, values))
    return {d: sorted(v, key=lambda r: r[0]) for d, v in series.items()}


def collected(df, column=PRESSURE):
    series = defaultdict(list)
    for r in df.orderBy("timestamp").collect():
        series[r.device_id].append(r[column])
    return series


@pytest.mark.parametrize("name", ["whole", "day", "hour"])
def test_repair_matches_python(frame, name):
    rows = skewed_rows()
    df, layout = frame(rows), LAYOUTS[name]
    for column in (PRESSURE, "motor_speed"):
        filled = collected(forward_fill(df, SENSORS, layout), column)
        drawn = collected(interpolate(df, SENSORS, layout), column)
        for device, series in by_device(rows).items():
            values = [None if v.get(column) is None else float(v[column]) for _, v in series]
            assert filled[device] == fill_python(values)
            for got, want in zip(drawn[device], line_python(values), strict=True):
                assert (got is None) == (want is None)
                assert want is None or math.isclose(got, want, rel_tol=1e-12)


@pytest.mark.parametrize("name", ["whole", "day", "hour"])
def test_flatlines_match_python(frame, contract, name):
    rows = skewed_rows(11)
    got = defaultdict(list)
    for r in flatline_periods(frame(rows), contract, LAYOUTS[name]).collect():
        got[r.device_id, r.sensor].append((r.value, r.minutes, r.readings))
    for device, series in by_device(rows).items():
        for sensor in (PRESSURE, "motor_speed"):
            values = [None if v.get(sensor) is None else float(v[sensor]) for _, v in series]
            want = runs_python([m for m, _ in series], values, contract.flatline_minutes[sensor])
            assert sorted(got[device, sensor]) == sorted((v, b - a, n) for v, a, b, n in want)


@pytest.mark.parametrize("name", ["day", "hour", "ties"])
def test_slices_change_nothing(frame, contract, name):
    """Also with equal timestamps, whose order is by hash."""
    rows = skewed_rows(3) + [(500, "hot", {PRESSURE: float(i % 5) if i % 3 else None}) for i in range(60)]
    df, layout = frame(rows), LAYOUTS[name]

    def same(f, columns):
        whole, sliced = f(Layout()), f(layout)
        assert sorted(map(str, whole.select(*columns).collect())) == sorted(map(str, sliced.select(*columns).collect()))

    same(lambda lay: forward_fill(df, SENSORS, lay), ["event_id", *SENSORS])
    same(lambda lay: interpolate(df, SENSORS, lay), ["event_id", *[F.round(s, 9).alias(s) for s in SENSORS]])
    same(lambda lay: interpolate(df, SENSORS, lay, by="time"), ["event_id", *[F.round(s, 9).alias(s) for s in SENSORS]])
    same(lambda lay: flatline_periods(df, contract, lay), ["*"])
    same(lambda lay: with_previous(df, lay, {"at": F.col("timestamp"), "p": F.col(PRESSURE)}), ["event_id", "prev_at", "prev_p"])
    same(lambda lay: reading_gaps(df, 3.0, lay), ["*"])


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_interpolation_is_by_position(frame, name):
    values = [None, 1.0, None, None, 4.0, None]
    rows = [(m, "d", {PRESSURE: v}) for m, v in zip([0, 1, 2, 10, 11, 12], values)]
    df, layout = frame(rows), LAYOUTS[name]
    assert collected(interpolate(df, [PRESSURE], layout))["d"] == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert collected(forward_fill(df, [PRESSURE], layout))["d"] == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    by_time = collected(interpolate(df, [PRESSURE], layout, by="time"))["d"]
    assert by_time[2] == pytest.approx(1.3) and by_time[3] == pytest.approx(3.7)


def test_drop_and_fill(frame):
    full = dict.fromkeys(SENSORS, 1.0)
    df = frame([(0, "d", full), (1, "d", {**full, "motor_speed": None})])
    assert drop_missing(df, SENSORS).count() == 1
    assert fill_constant(df, {"motor_speed": 3.0}).filter("motor_speed = 3").count() == 1
    assert impute(df, "fill", SENSORS, fill_values={"motor_speed": 3.0}).count() == 2
    with pytest.raises(ValueError, match="value"):
        impute(df, "fill", SENSORS)
    with pytest.raises(ValueError):
        impute(df, "guess", SENSORS)


def test_rows_without_key_or_time_stay(frame):
    df = frame([(0, "d", {PRESSURE: 1}), (1, None, {PRESSURE: None}), (None, "d", {PRESSURE: 2}), (3, "d", {})])
    for layout in (Layout(), Layout(slice_us=DAY)):
        assert interpolate(df, SENSORS, layout).count() == 4
        assert forward_fill(df, SENSORS, layout).count() == 4
        assert with_previous(df, layout, {"p": F.col(PRESSURE)}).count() == 4


def test_rows_without_key_or_time_take_no_part(frame):
    """The same values in every layout: strangers neither give nor take."""
    rows = [(None, "d", {PRESSURE: 9}), (0, "d", {}), (10, "d", {PRESSURE: 5}), (20, "d", {}), (30, "d", {PRESSURE: 7})]
    rows += [(0, None, {PRESSURE: 1}), (10, None, {}), (20, None, {PRESSURE: 3})]
    df = frame(rows)
    for layout in (Layout(), Layout(slice_us=DAY), Layout(slice_us=600_000_000), Layout.of(df, "auto")):
        lines = {r.event_id: r[PRESSURE] for r in interpolate(df, [PRESSURE], layout).collect()}
        assert [lines[f"e{i:04d}"] for i in range(8)] == [9, None, 5, 6, 7, 1, None, 3]
        steps = {r.event_id: r[PRESSURE] for r in forward_fill(df, [PRESSURE], layout).collect()}
        assert [steps[f"e{i:04d}"] for i in range(8)] == [9, None, 5, 5, 7, 1, None, 3]
        before = {r.event_id: r.prev_p for r in with_previous(df, layout, {"p": F.col(PRESSURE)}).collect()}
        assert [before[f"e{i:04d}"] for i in range(8)] == [None, None, None, 5, None, None, None, None]


def test_measuring_leaves_out_rows_without_key_or_time(frame):
    df = frame([(None, "d", {})] * 10 + [(k, None, {}) for k in range(10)] + [(0, "d", {})])
    assert Layout.of(df, "auto", target_rows=5) == Layout()


@pytest.mark.parametrize(
    ("minutes", "values", "want"),
    [
        ([0, 15, 30], [5, 5, 5], 1),
        ([0, 15, 29], [5, 5, 5], 0),
        ([0, 15, 20, 25, 40], [5, 5, None, 5, 5], 0),
        ([0, 20, 40, 60], [0, 0, 0, 0], 1),
        ([0, 600], [5, 5], 1),
        ([0, 15, 30], [math.nan, math.nan, math.nan], 0),
    ],
)
def test_flatline_cases(frame, contract, minutes, values, want):
    df = frame([(m, "d", {PRESSURE: v}) for m, v in zip(minutes, values)])
    for layout in (Layout(), Layout(slice_us=600_000_000)):
        counts = flatline_counts(df, contract, layout).collect()
        assert (counts[0].flatline_periods if counts else 0) == want
    rows = Layout().sliced_rows(df)
    ending = flatlines_ending_here(rows, contract.flatline_minutes, Layout().forward())
    assert ending.agg(F.sum("_flat")).first()[0] == want


def test_same_device_name_at_two_stations(frame):
    one = frame([(0, "d", {PRESSURE: 1}), (2, "d", {PRESSURE: None}), (4, "d", {PRESSURE: 3})])
    two = frame([(1, "d", {PRESSURE: 9}), (3, "d", {PRESSURE: None})], station="s2")
    rows = forward_fill(one.unionByName(two), [PRESSURE]).filter("station_id = 's2'").orderBy("timestamp").collect()
    assert [r[PRESSURE] for r in rows] == [9.0, 9.0]


def test_layout_is_measured(frame):
    df = frame([(m, "d", {}) for m in range(0, 3000, 10)])
    assert measure_layout(df, target_rows=1000) == Layout()
    assert measure_layout(df, target_rows=200).slice_us == DAY
    assert measure_layout(df, target_rows=10).slice_us == HOUR
    still = frame([(0, "d", {}) for _ in range(300)])
    assert measure_layout(still, target_rows=10).tie_bits > 0
    assert measure_layout(df.filter("false")) == Layout()


def test_equal_timestamps_are_split(frame):
    """A clock that stands still must not gather a device in one slice."""
    df = frame([(0, "d", {PRESSURE: i}) for i in range(400)])
    layout = LAYOUTS["ties"]
    assert layout.sliced_rows(df).select(SUB).distinct().count() > 100


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_input_order_does_not_matter(frame, contract, seed):
    rows = skewed_rows(5, 120) + [(7, "hot", {PRESSURE: 2}), (7, "hot", {PRESSURE: None})]
    shuffled = random.Random(seed).sample(rows, len(rows))

    def result(data):
        # No event ids: ties are ordered by the row itself.
        out = interpolate(frame(data, event_ids=False), SENSORS, Layout(slice_us=DAY))
        return sorted(map(str, out.collect()))

    assert result(rows) == result(shuffled)


def test_forward_fill_twice_is_once(frame):
    df = forward_fill(frame(skewed_rows(1, 150)), SENSORS, Layout(slice_us=DAY))
    assert sorted(map(str, df.collect())) == sorted(map(str, forward_fill(df, SENSORS).collect()))


def test_a_stray_old_reading_on_a_fine_grid(spark):
    """One reading a day before the others, buckets of a second: rows in small arrays, no join."""
    rows = spark.createDataFrame(
        [("s", "d", "2024-01-01T00:00:00", 1.0), ("s", "d", "2024-01-02T00:00:00", 2.0), ("s", "d", "2024-01-02T00:00:03", 3.0)],
        "station_id string, device_id string, t string, value double",
    ).selectExpr("station_id", "device_id", "cast(t as timestamp) as timestamp", "value")
    grid = fill_grid(rows, "1s")
    assert grid.count() == 86_404 and grid.filter("value is not null").count() == 3
    assert grid.select("timestamp").distinct().count() == 86_404
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()
