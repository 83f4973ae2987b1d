"""Event streams: malformed input, repeats, restarts, late data."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.plans.incremental import PERIODS, with_period
from airmetrics.plans.stations import run_pipeline
from airmetrics.sources.events import (
    dead_letters,
    dedupe,
    event_json,
    good_events,
    json_files_stream,
    long_readings,
    parse_events,
)
from airmetrics.sources.folders import shared_folder
from airmetrics.sources.snapshots import read_snapshots
from airmetrics.streaming.consumer import (
    StreamTables,
    backfill,
    backlog,
    backlog_status,
    batch_handler,
    batch_log,
    compact_bronze,
    day_totals,
    drop_bronze_before,
    drop_dead_letters_before,
    late_days,
    processing_status,
    replay,
    replay_late,
    start_stream,
    waiting_files,
)
from airmetrics.streaming.windows import dedupe_stream, window_aggregates
from tests.conftest import SENSORS
from tests.test_series import skewed_rows

HOURLY = PipelineConfig("1h")
PRESSURE = "discharge_pressure"


def event(event_id, minute=0, device="d", **readings):
    stamp = f"2024-01-{1 + minute // 1440:02d}T{minute // 60 % 24:02d}:{minute % 60:02d}:00+00:00"
    values = {s: readings.get(s) for s in SENSORS}
    return {
        "event_id": event_id, "event_type": "sensor_reading", "timestamp": stamp, "station_id": "s1",
        "device_id": device, "readings": values, "metadata": {"source": "test", "produced_at": stamp},
    }


BROKEN = [
    {"event_id": "m", "event_type": "sensor_reading", "readings": {PRESSURE: 7.0}, "metadata": {}},
    {**event("b"), "readings": {PRESSURE: "not_a_number", "air_flow_rate": [1, 2, 3]}},
    {"event_id": "c", "garbage": "this is not a valid event", "random_number": 5},
]


def raw(spark, events):
    texts = [e if isinstance(e, str) else json.dumps(e) for e in events]
    return spark.createDataFrame([(t,) for t in texts], "raw string")


def land(spark, path, name, events):
    raw(spark, events).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def test_reasons(spark, contract):
    events = [event("g", discharge_pressure=7), *BROKEN, "no json", {**event("t"), "timestamp": "soon"},
              {**event("n"), "device_id": None}]
    parsed = parse_events(raw(spark, events), contract)
    reasons = {r.event_id: r.reason for r in dead_letters(parsed).collect()}
    assert reasons == {"m": "missing_field", "b": "bad_type", "c": "corrupt", None: "corrupt", "t": "bad_type",
                       "n": "missing_field"}
    good = good_events(parsed).collect()
    assert [(r.event_id, r[PRESSURE], r.motor_speed) for r in good] == [("g", 7.0, None)]
    assert long_readings(good_events(parsed), contract).count() == 5


def test_dedupe_is_the_same_in_any_order(spark, contract):
    events = [event("x", 0, discharge_pressure=1), event("x", 0, discharge_pressure=2), event("y", 5)]
    for order in (events, events[::-1]):
        rows = dedupe(good_events(parse_events(raw(spark, order), contract))).orderBy("event_id").collect()
        assert [(r.event_id, r[PRESSURE]) for r in rows] == [("x", 1.0), ("y", None)]


def test_event_text_round_trip(spark, contract, frame):
    df = frame([(0, "d", {PRESSURE: 7.25}), (1, "d", {})])
    back = good_events(parse_events(df.select(event_json(df, contract).alias("raw")), contract))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*back.columns).collect()))


def test_consumer_equals_batch(spark, contract, frame):
    """Two runs over growing input: same snapshots as a batch run over the deduplicated events."""
    src, base = shared_folder(spark, "src"), shared_folder(spark, "out")
    df = frame(skewed_rows(9, 260))
    texts = [r[0] for r in df.select(event_json(df, contract)).collect()]
    land(spark, src, "a", texts[:150] + BROKEN)
    tables = StreamTables(base, contract)
    start_stream(json_files_stream(spark, f"{src}/*", 1), base, contract, HOURLY).awaitTermination()
    # A restart with repeated events, in another order, and new ones.
    land(spark, src, "b", texts[:40] + texts[150:][::-1] + BROKEN[:1])
    query = start_stream(json_files_stream(spark, f"{src}/*", 1), base, contract, HOURLY)
    query.awaitTermination()
    assert backlog(query)["input_rows"] >= 0 and backlog(query)["dropped_late"] == 0
    assert waiting_files(spark, f"{src}/*", tables) == 0
    land(spark, src, "c d", texts[:1])
    land(spark, src, "e", texts[:1])
    assert waiting_files(spark, f"{src}/*", tables) == 2
    assert waiting_files(spark, f"{src}/*", StreamTables(shared_folder(spark, "new"), contract)) == 4
    (now,) = backlog_status(spark, f"{src}/*", tables).collect()
    assert (now.waiting_files, now.batch_id) == (2, 1) and now.lag_seconds > 0 and now.rows_per_second > 0
    assert now.waiting_bytes == 2 * (len(texts[0]) + 1) and now.waiting_since is not None

    def by_day(rows):
        return {(str(r.window_start), str(r.data_quality), str(r.metrics)) for r in rows}

    batch = run_pipeline(with_period(df), contract, HOURLY, by=PERIODS).results
    assert by_day(read_snapshots(spark, tables.snapshots).collect()) == by_day(batch.collect())
    status = processing_status(spark, tables).first()
    assert (status.received, status.processed, status.errors) == (304, 300, 4)
    assert (status.missing_field, status.bad_type, status.corrupt) == (2, 1, 1)
    assert status.lag_seconds > 0
    assert tables.read_dead_letters(spark).count() == 4
    assert tables.read_bronze(spark).count() == 300
    assert backfill(spark, tables, "2024-01-02T00:00:00Z", "2024-01-02T12:00:00Z").count() == df.filter(
        "timestamp between timestamp'2024-01-02 00:00:00' and timestamp'2024-01-02 12:00:00'"
    ).count()
    days = {str(r.window_start_ts.date()) for r in replay(spark, tables, "2024-01-02", "2024-01-02T23:59:59", HOURLY).collect()}
    assert days == {"2024-01-02"}
    assert len(drop_dead_letters_before(spark, tables, "9999-01-01")) == 1
    assert tables.read_dead_letters(spark).count() == 0 if tables else True


def test_repeated_batch_replaces_itself(spark, contract):
    tables = StreamTables(shared_folder(spark, "out"), contract)
    handle = batch_handler(tables, HOURLY)
    batch = raw(spark, [event("a", 0), event("b", 60), BROKEN[0]]).withColumn(
        "ingested_at", F.lit("2024-02-01 00:00:00").cast("timestamp")
    )
    handle(batch, 0)
    handle(batch, 0)
    assert tables.read_bronze(spark).count() == 2 and tables.read_dead_letters(spark).count() == 1
    assert processing_status(spark, tables).first().received == 3
    assert read_snapshots(spark, tables.snapshots).count() == 1


def test_copies_are_removed_once_and_a_repeated_batch_moves_days_again(spark, contract, monkeypatch):
    """Snapshots, edges and summaries share the rows of a batch; other days are read where they get other values."""
    tables, asked, whole = StreamTables(shared_folder(spark, "once"), contract), [], StreamTables.readings
    note = lambda self, spark, days=None: asked.append(sorted(d.day for d in days)) or whole(self, spark, days)
    handle = batch_handler(tables, HOURLY, lookback=True)
    first = [event("a", 0, discharge_pressure=5), event("b", 2880), event("c", 2881, discharge_pressure=7)] * 2
    with monkeypatch.context() as patch:
        patch.setattr(StreamTables, "readings", note)
        # Day 3 begins without a pressure: it looks back to day 1, and then to day 2. The last batch comes twice.
        for batch_id, events in ((0, first), (1, [event("d", 1440, discharge_pressure=6)]), (1, [event("d", 1440, discharge_pressure=6)])):
            handle(raw(spark, events + BROKEN).withColumn("ingested_at", F.current_timestamp()), batch_id)
    assert asked == [[1, 3], [], [2], [3], [2], [3]]
    found = day_totals(spark, tables, HOURLY).select("reading_count", "average_pressure_bar").collect()
    devices = run_pipeline(tables.readings(spark).drop("period"), contract, HOURLY).devices
    assert found == devices.select("reading_count", "average_pressure_bar").collect()
    assert sorted(r.reason for r in tables.read_dead_letters(spark).where("raw IS NOT NULL").collect()) == sorted(2 * ["missing_field", "bad_type", "corrupt"])


def test_empty_consumer(spark, contract):
    tables = StreamTables(shared_folder(spark, "none"), contract)
    assert processing_status(spark, tables).first().processed == 0
    assert tables.readings(spark).count() == 0
    assert batch_log(spark, tables).count() == 0
    source = shared_folder(spark, "src")
    raw(spark, ["x"]).coalesce(1).write.text(source)
    (now,) = backlog_status(spark, source, tables).collect()
    assert (now.waiting_files, now.batch_id, now.rows_per_second) == (1, None, None)


@pytest.mark.parametrize("salts", [1, 4])
def test_stream_windows_and_late_data(spark, contract, salts):
    """Repeats count once, closed buckets are emitted once, rows behind the watermark are dropped."""
    src, base = shared_folder(spark, "src"), shared_folder(spark, "out")
    first = [event("a", 1, discharge_pressure=4), event("a", 1, discharge_pressure=4),
             event("b", 2, discharge_pressure=99), event("c", 240, discharge_pressure=8)]
    land(spark, src, "1", first)

    def run():
        good = good_events(parse_events(json_files_stream(spark, f"{src}/*", 1), contract))
        windows = window_aggregates(dedupe_stream(good, "10 minutes", salts), contract, "1h", delay=None)
        query = (windows.writeStream.format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        return [(r.timestamp.hour, r.readings, r.anomaly_rows, r[PRESSURE])
                for r in spark.read.schema(windows.schema).parquet(f"{base}/out").orderBy("timestamp").collect()]

    assert run() == [(0, 2, 1, 4.0)]
    land(spark, src, "2", [event("late", 3), event("d", 241, discharge_pressure=6), event("z", 400)])
    assert run() == [(0, 2, 1, 4.0), (4, 2, 0, 7.0)]


def stamped(spark, events):
    return raw(spark, events).withColumn("ingested_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))


def files_of(folder):
    return len(list(Path(folder).rglob("part-*.parquet")))


def test_many_batches_become_few_files(spark, contract):
    tables = StreamTables(shared_folder(spark, "out"), contract)
    handle = batch_handler(tables, HOURLY, snapshots=False)
    batches = [[event(f"{day}-{n}", 1440 * day + n, discharge_pressure=n) for day in (0, 1)] for n in range(6)]
    for n, events in enumerate(batches):
        handle(stamped(spark, events), n)
    assert read_snapshots(spark, tables.snapshots).count() == 0

    def held():
        return sorted((r.event_id, r.batch_id, r[PRESSURE]) for r in tables.read_bronze(spark).collect())

    def rebuilt():
        rows = replay(spark, tables, config=HOURLY).collect()
        return sorted((r.slot, str(r.metrics), str(r.data_quality)) for r in rows)

    before, snapshots = held(), rebuilt()
    assert compact_bronze(spark, tables, min_batches=7) == []
    assert len(compact_bronze(spark, tables, min_batches=4)) == 2
    assert held() == before and rebuilt() == snapshots
    # The newest batch is not in the version: it may come again.
    handle(stamped(spark, batches[5]), 5)
    assert held() == before
    # The replaced files stay for readers that run, until the next compaction.
    assert files_of(tables.bronze.raw) == 12
    planned = tables.read_bronze(spark)
    handle(stamped(spark, [event("late", 3), event("new", 2880)]), 6)
    assert compact_bronze(spark, tables, min_batches=2) == []
    assert len(compact_bronze(spark, tables, min_batches=1)) == 2
    assert planned.count() == 12 and len(held()) == 14
    # Two days in versions, and what is of the newest batch.
    tables.bronze.clean(spark)
    assert files_of(tables.bronze.raw) + files_of(tables.bronze.compact) <= 5 and len(held()) == 14
    assert drop_bronze_before(spark, tables, "2024-01-02") == ["2024-01-01"]
    assert {r[0][0] for r in held()} == {"1", "n"}


def test_a_compaction_that_died_is_not_seen(spark, contract):
    tables = StreamTables(shared_folder(spark, "out"), contract)
    handle = batch_handler(tables, HOURLY, snapshots=False)
    for n in range(3):
        handle(stamped(spark, [event(f"e{n}", n)]), n)
    rows = tables.read_bronze(spark)
    rows.write.partitionBy("day").parquet(f"{tables.bronze.compact}/version=dead")
    assert tables.read_bronze(spark).count() == 3
    compact_bronze(spark, tables, min_batches=2)
    assert not Path(f"{tables.bronze.compact}/version=dead").exists()
    assert tables.read_bronze(spark).count() == 3
    empty = StreamTables(shared_folder(spark, "none"), contract)
    assert compact_bronze(spark, empty) == [] and empty.read_bronze(spark).count() == 0


def test_late_events_wait_for_a_replay(spark, contract):
    tables = StreamTables(shared_folder(spark, "out"), contract)
    handle = batch_handler(tables, HOURLY, lateness="1 hour")
    handle(stamped(spark, [event("a", 10, discharge_pressure=4), event("b", 1500, discharge_pressure=4)]), 0)
    second = [event("c", 20, discharge_pressure=8), event("d", 1490), event("e", 1441), *BROKEN]
    for _ in range(2):  # a repeated batch has the same watermark
        handle(stamped(spark, second), 1)
    late = tables.read_late(spark).collect()
    assert sorted(r.event_id for r in late) == ["c"]
    assert {str(r.watermark) for r in late} == {"2024-01-02 00:00:00"}

    def rows_of(slot):
        return {r.slot: r.metrics.extras.rows_processed for r in read_snapshots(spark, tables.snapshots).collect()}[slot]

    # The first day was not redone; bronze has the event.
    assert rows_of("period 2024-01-01") == 1 and rows_of("period 2024-01-02") == 2
    assert tables.read_bronze(spark).count() == 5
    assert [tuple(r) for r in late_days(spark, tables).collect()] == [("s1", late[0].day, 1)]
    assert replay_late(spark, tables, HOURLY).count() == 1
    day = {r.slot: r for r in read_snapshots(spark, tables.snapshots).collect()}["period 2024-01-01"]
    assert day.metrics.devices[0].metrics.average_pressure_bar == 6.0
    assert late_days(spark, tables).count() == 0 and replay_late(spark, tables, HOURLY).count() == 0
    status = processing_status(spark, tables).first()
    assert (status.processed, status.errors) == (5, 3)
    log = batch_log(spark, tables).orderBy("batch_id").collect()
    assert [(r.batch_id, r.received, r.processed, r.errors, r.late) for r in log] == [(0, 2, 2, 0, 0), (1, 6, 3, 3, 1)]
    assert log[0].watermark is None and log[1].watermark == late[0].watermark
    assert log[1].newest_event_at == log[0].last_event_at > log[1].last_event_at
    assert all(r.seconds > 0 and r.rows_per_second > 0 for r in log)
