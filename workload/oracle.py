"""The same results in plain SQL, for comparison on the shared tables."""

from __future__ import annotations

from workload.tables import CONTRACT, SENSORS

# Doubles are compared after the same rounding as in the Spark queries.
DIGITS = 6
KEYS = "station_id, device_id"
SERIES = f"partition by {KEYS} order by timestamp, event_id"

READINGS = """
e as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
r as (
  select event_id, ts as timestamp,
    concat('station_', user_id % 4) as station_id,
    concat('compressor_', (user_id // 4) % 3) as device_id,
    case when event_type = 'error' then null else value / 8.0 end as discharge_pressure,
    case when k % 10 = 0 then null when event_type = 'signup' then 0.0 else value * 4.0 end as air_flow_rate,
    case when k % 17 = 0 then null when event_type = 'signup' then 0.0 else value end as power_consumption,
    cast(case when event_type = 'signup' then 0 else k * 45 end as double) as motor_speed,
    cast(case when k % 25 = 0 then null else 25.0 + 30.0 * (k // 50) end as double) as discharge_temp
  from e)"""


def r6(expression: str) -> str:
    return f"round(cast({expression} as double) + 1e-10, {DIGITS})"


def each(template: str, names: tuple[str, ...] = SENSORS, sep: str = ", ") -> str:
    """The template once per sensor, with ``{s}``, range and flatline values filled in."""
    parts = []
    for s in names:
        lo, hi = CONTRACT.spec(s).valid_range
        tlo, thi = CONTRACT.typical_ranges[s]
        minutes = CONTRACT.flatline_minutes[s]
        parts.append(template.format(s=s, lo=lo, hi=hi, tlo=tlo, thi=thi, minutes=minutes))
    return sep.join(parts)


BAD = "({s} is not null and ({s} < {lo} or {s} > {hi}))"
ANY_BAD = each(BAD, sep=" or ")
ROUNDED = each("round(cast({s} as double) + 1e-10, 6) as {s}")
ROW_KEYS = "event_id, timestamp, station_id, device_id"
BUCKET_KEYS = "station_id, device_id, timestamp"

VALID = f"v as (select {ROW_KEYS}, {each('case when not ' + BAD + ' then {s} end as {s}')} from r)"

FFILL = f"""f as (select {ROW_KEYS},
  {each('last_value({s} ignore nulls) over w as {s}')}
  from v window w as ({SERIES} rows between unbounded preceding and current row))"""


def interpolated(name: str, by: str) -> str:
    place = "epoch_us(timestamp)" if by == "time" else f"row_number() over ({SERIES})"
    near = each(
        "last_value({s} ignore nulls) over p as a_{s}, first_value({s} ignore nulls) over n as b_{s}, "
        "last_value(case when {s} is not null then place end ignore nulls) over p as a_at_{s}, "
        "first_value(case when {s} is not null then place end ignore nulls) over n as b_at_{s}"
    )
    value = each(
        "coalesce({s}, a_{s} + (b_{s} - a_{s}) * (place - a_at_{s}) / nullif(b_at_{s} - a_at_{s}, 0)) as {s}"
    )
    return f"""
{name}_at as (select *, {place} as place from v),
{name}_near as (select *, {near} from {name}_at
  window p as ({SERIES} rows between unbounded preceding and current row),
         n as ({SERIES} rows between current row and unbounded following)),
{name} as (select {ROW_KEYS}, {value} from {name}_near)"""


def bucketed(name: str, source: str, interval: str) -> str:
    return f"""{name} as (select {KEYS}, time_bucket(interval '{interval}', timestamp) as timestamp,
  {each('avg({s}) as {s}')} from {source} group by all)"""


ON = "(coalesce(motor_speed, 0) > 1.0 or coalesce(power_consumption, 0) > 0.5)"


def metrics(name: str, source: str, keys: str = KEYS, max_gap: int | None = None) -> str:
    dt = "((epoch_us(timestamp) - epoch_us(p_ts)) // 1000000)"
    if max_gap is not None:
        dt = f"(case when {dt} <= {max_gap} then {dt} end)"
    ratio = "case when abs(air_flow_rate) > 0.001 then power_consumption / air_flow_rate end"
    powered = "filter (where power_consumption > 0.5)"
    return f"""
{name}_on as (select *, {ON} as is_on from {source}),
{name}_lag as (select *, lag(timestamp) over w as p_ts, lag(is_on) over w as p_on, lag(air_flow_rate) over w as p_flow
  from {name}_on window w as (partition by {keys} order by timestamp)),
{name} as (select {keys},
  cast(coalesce(sum(case when is_on and p_on then {dt} end), 0) as bigint) as uptime_seconds,
  avg(discharge_pressure) as average_pressure_bar,
  max(discharge_pressure) as peak_pressure_bar,
  avg(case when isfinite({ratio}) then {ratio} end) as specific_power_kw_per_m3h,
  count(case when is_on and not coalesce(p_on, false) then 1 end) as cycle_count,
  coalesce(sum((air_flow_rate + p_flow) / 2 * ({dt} / 3600.0)), 0) as total_flow_volume_m3,
  avg(discharge_temp) {powered} / avg(power_consumption) {powered} as thermal_efficiency_temp_per_kw,
  count(*) as reading_count,
  stddev_samp(discharge_pressure) as pressure_std_bar
  from {name}_lag group by all)"""


METRICS_OUT = f"""uptime_seconds, {r6('average_pressure_bar')} as average_pressure_bar,
  {r6('peak_pressure_bar')} as peak_pressure_bar,
  {r6('specific_power_kw_per_m3h')} as specific_power_kw_per_m3h, cycle_count,
  {r6('total_flow_volume_m3')} as total_flow_volume_m3,
  {r6('thermal_efficiency_temp_per_kw')} as thermal_efficiency_temp_per_kw, reading_count,
  {r6('pressure_std_bar')} as pressure_std_bar"""


def runs(name: str, source: str, order: str = "timestamp, event_id") -> str:
    """Flatlines of every sensor in ``source``."""
    long = each("select {s} as value, '{s}' as sensor, {minutes} as threshold, * from " + source, sep=" union all by name ")
    w = f"partition by {KEYS}, sensor order by {order}"
    return f"""
{name}_long as ({long}),
{name}_brk as (select *, case when value is null or lag(value) over ({w}) is distinct from value then 1 else 0 end as brk
  from {name}_long),
{name}_id as (select *, sum(brk) over ({w} rows unbounded preceding) as run from {name}_brk),
{name} as (select {KEYS}, sensor, max(value) as value, min(timestamp) as "start", max(timestamp) as "end",
    (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60000000.0 as minutes, count(*) as readings
  from {name}_id where value is not null group by {KEYS}, sensor, run
  having count(*) >= 2 and (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) >= max(threshold) * 60000000::bigint)"""


def sql(ctes: list[str], select: str) -> str:
    return "with " + ",\n".join(c.strip() for c in [READINGS, *ctes]) + "\n" + select


INTERPOLATED = interpolated("i", "row")
HOURLY = bucketed("h", "i", "1 hour")
CLEAN = [VALID, INTERPOLATED, HOURLY]
METRICS = [*CLEAN, metrics("m", "h")]
# Some rows without station, device or time: they belong to no series and stay as they are.
SOME_NULL = """n0 as (select * replace (case when event_id % 13 <> 0 then station_id end as station_id,
  case when event_id % 17 <> 0 then device_id end as device_id,
  case when event_id % 19 <> 0 then timestamp end as timestamp) from r)"""
PLACED = "station_id is not null and device_id is not null and timestamp is not null"
FFILLED = each("round(cast({s} as double) + 1e-10, 6) as ffill_{s}")
NULL_ROWS = "with " + ",\n".join(
    [
        READINGS.strip(),
        SOME_NULL,
        VALID.replace("v as", "w as").replace("from r)", "from n0)"),
        f"v as (select * from w where {PLACED})",
        INTERPOLATED.strip(),
        FFILL,
        f"rest as (select * from w where not ({PLACED}))",
        f"lines as (select {ROW_KEYS}, {ROUNDED} from i union all select {ROW_KEYS}, {ROUNDED} from rest)",
        f"steps as (select event_id, {FFILLED} from f union all select event_id, {FFILLED} from rest)",
    ]
) + "\nselect * from lines join steps using (event_id)"
ROWS_OUT = f"select {ROW_KEYS}, {ROUNDED} from "
BUCKETS_OUT = f"select {BUCKET_KEYS}, {ROUNDED} from "
FLATLINES_OUT = (
    f'select {KEYS}, sensor, {r6("value")} as value, "start", "end", {r6("minutes")} as minutes, readings, value = 0 as is_off from fl'
)
ISO = "strftime({t}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

GAPS = f"""
with_lag as (select {KEYS}, lag(timestamp) over ({SERIES}) as gap_start, timestamp as gap_end from r),
steps as (select *, (epoch_us(gap_end) - epoch_us(gap_start)) // 1000000 as seconds from with_lag where gap_start is not null),
usual as (select {KEYS}, quantile_disc(seconds, 0.5) as nominal_seconds from steps group by all)"""
GAPS_SQL = sql(
    [GAPS],
    f"select {KEYS}, gap_start, gap_end, seconds, nominal_seconds from steps join usual using ({KEYS}) "
    "where seconds > nominal_seconds * 3.0",
)

REPORT = [
    *CLEAN,
    runs("fl", "v"),
    runs("fh", "(select *, 0 as event_id from h)"),
    "pre as (select station_id, count(*) as n from fl group by all)",
    "post as (select station_id, count(*) as n from fh group by all)",
    f"""raw as (select station_id, count(*) as rows_before, count(case when {ANY_BAD} then 1 end) as anomaly_rows,
  {each('count(case when ' + BAD + ' then 1 end) as oor_{s}')},
  {each('avg(cast({s} is null as int)) as missing_before_{s}')},
  avg(cast(timestamp is null as int)) as missing_before_timestamp,
  avg(cast(station_id is null as int)) as missing_before_station_id,
  avg(cast(device_id is null as int)) as missing_before_device_id
  from r group by all)""",
    f"""after as (select station_id, count(*) as rows_after, {each('avg(cast({s} is null as int)) as missing_after_{s}')}
  from h group by all)""",
    f"""dq as (select raw.*, after.* exclude (station_id), coalesce(pre.n, 0) as flat_pre, coalesce(post.n, 0) as flat_post,
  100 * (1 - least(1, 0.5 * ({each('missing_after_{s}', sep=' + ')}) / 5.0
    + 0.5 * ({each('oor_{s}', sep=' + ')}) / rows_before)) as score
  from raw join after using (station_id) left join pre using (station_id) left join post using (station_id))""",
]
REPORT_OUT = f"""select station_id, rows_before, rows_after, anomaly_rows, flat_pre, flat_post, {each('oor_{s}')},
  {', '.join(f"round(missing_before_{c} + 1e-10, 6) as missing_before_{c}" for c in ('timestamp', 'station_id', 'device_id', *SENSORS))},
  {each('round(missing_after_{s} + 1e-10, 6) as missing_after_{s}')},
  round(round(score, 2) + 1e-10, 6) as data_quality_score from dq"""

# The stream: which deliveries are good, and what they carry after a trip through JSON text.
GOOD = "event_id % 50 not in (0, 1, 2)"
COPIES = "case when event_id % 7 = 3 then 2 else 1 end"
DAY = "cast(timestamp as date)"
GOOD_DAYS = [
    f"g as (select * from r where {GOOD})",
    VALID.replace("from r", "from g"),
]


def daily_runs(source: str, name: str = "d") -> list[str]:
    """Every station day as a window of its own: interpolate, 1 h buckets, metrics."""
    by_day = SERIES.replace(KEYS, f"{KEYS}, cast(timestamp as date)")
    body = interpolated("i", "row").replace(SERIES, by_day)
    return [
        body,
        HOURLY,
        f"{name}_days as (select *, {DAY} as day from h)",
        metrics(name, f"{name}_days", f"{KEYS}, day"),
    ]


SPLIT_DAYS = [
    *GOOD_DAYS,
    *daily_runs("v"),
]
DAY_METRICS_OUT = (
    f"select station_id, day, device_id, reading_count, uptime_seconds, {r6('total_flow_volume_m3')} as total_flow_volume_m3 from d"
)

TYPICAL = each(
    "select station_id, device_id, '{s}' as sensor, count({s}) as \"values\", "
    "round(avg(cast({s} < {tlo} or {s} > {thi} as int)) + 1e-10, 6) as outside_share from v group by all",
    sep=" union all ",
)

DAILY_HEALTH = f"""
t_on as (select *, {ON} as is_on from h),
t_lag as (select *, lag(timestamp) over w as p_ts, lag(is_on) over w as p_on from t_on
  window w as (partition by {KEYS} order by timestamp)),
t as (select {KEYS}, cast(timestamp as date) as day,
  cast(coalesce(sum(case when is_on and p_on then (epoch_us(timestamp) - epoch_us(p_ts)) // 1000000 end), 0) as bigint) as uptime_seconds,
  cast(coalesce(sum((epoch_us(timestamp) - epoch_us(p_ts)) // 1000000), 0) as bigint) as observed_seconds,
  avg(discharge_pressure) as average_pressure_bar from t_lag group by all),
td as (select *, uptime_seconds / nullif(observed_seconds, 0) as uptime_share,
  average_pressure_bar / 9.5 - 1 as pressure_vs_target from t)"""

CHECKS = " union all ".join(
    [
        "select 'timestamp' as \"column\", count(*) as rows, 0 as invalid, count(*) - count(timestamp) as required_missing from r",
        "select 'station_id', count(*), 0, count(*) - count(station_id) from r",
        "select 'device_id', count(*), 0, count(case when event_id % 11 = 0 then 1 end) from r",
        *[
            f"select '{s}', count(*), count(case when event_id % {20 + i} = 0 then 1 end), 0 from r"
            for i, s in enumerate(SENSORS)
        ],
    ]
)

ORACLE: dict[str, str] = {
    "read_window": sql(
        [],
        f"select {ROW_KEYS}, {ROUNDED} from r where station_id in ('station_1', 'station_3') "
        "and timestamp between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'",
    ),
    "contract_check": sql([], CHECKS),
    "contract_evolution": sql([], ROWS_OUT + "r"),
    "range_nulling": sql([VALID], ROWS_OUT + "v"),
    "oor_counts": sql(
        [], f"select station_id, count(*) as rows, {each('count(case when ' + BAD + ' then 1 end) as {s}')} from r group by all"
    ),
    "anomaly_rows": sql(
        [], f"select station_id, count(*) as rows, count(case when {ANY_BAD} then 1 end) as anomaly_rows from r group by all"
    ),
    "missing_raw": sql(
        [],
        f"""select station_id, count(*) as rows, round(avg(cast(timestamp is null as int)) + 1e-10, 6) as timestamp,
  round(avg(cast(station_id is null as int)) + 1e-10, 6) as station_id_missing,
  round(avg(cast(device_id is null as int)) + 1e-10, 6) as device_id,
  {each('round(avg(cast({s} is null as int)) + 1e-10, 6) as {s}')} from r group by station_id""",
    ),
    "missing_resampled": sql(
        [VALID, bucketed("h", "v", "1 hour")],
        f"select station_id, count(*) as rows, {each('round(avg(cast({s} is null as int)) + 1e-10, 6) as {s}')} from h group by all",
    ),
    "missing_by_device": sql(
        [],
        " union all ".join(
            f"select station_id, device_id, '{c}' as \"column\", count(*) as rows, "
            f"round(avg(cast({c} is null as int)) * 100 + 1e-10, 6) as missing_pct from r group by station_id, device_id"
            for c in ("timestamp", *SENSORS)
        ),
    ),
    "typical_range": sql([VALID], TYPICAL),
    "drop_missing": sql([VALID], ROWS_OUT + "v where " + each("{s} is not null", sep=" and ")),
    "fill_constant": sql(
        [
            VALID,
            "x as (select * replace (coalesce(discharge_pressure, 7.5) as discharge_pressure, "
            "coalesce(discharge_temp, 20.0) as discharge_temp) from v)",
        ],
        ROWS_OUT + "x",
    ),
    "ffill": sql([VALID, FFILL], ROWS_OUT + "f"),
    "ffill_sliced": sql([VALID, FFILL], ROWS_OUT + "f"),
    "interpolate": sql([VALID, INTERPOLATED], ROWS_OUT + "i"),
    "interpolate_sliced": sql([VALID, INTERPOLATED], ROWS_OUT + "i"),
    "interpolate_by_time": sql([VALID, interpolated("i", "time")], ROWS_OUT + "i"),
    "resample_5m": sql([VALID, bucketed("b", "v", "5 minutes")], BUCKETS_OUT + "b"),
    "resample_1h": sql([VALID, bucketed("b", "v", "1 hour")], BUCKETS_OUT + "b"),
    "resample_1w": sql([VALID, bucketed("b", "v", "7 days")], BUCKETS_OUT + "b"),
    "resample_1mo": sql([VALID, bucketed("b", "v", "1 month")], BUCKETS_OUT + "b"),
    "resample_grid": sql(
        [
            VALID,
            bucketed("h", "v", "1 hour"),
            f"spans as (select {KEYS}, min(timestamp) as lo, max(timestamp) as hi from h group by all)",
            f"grid as (select {KEYS}, unnest(generate_series(lo, hi, interval '1 hour')) as timestamp from spans)",
        ],
        BUCKETS_OUT + f"(select * from grid left join h using ({KEYS}, timestamp))",
    ),
    "flatline_count": sql([VALID, runs("fl", "v")], "select station_id, count(*) as flatline_periods from fl group by all"),
    "flatline_periods": sql([VALID, runs("fl", "v")], FLATLINES_OUT),
    "flatline_periods_sliced": sql([VALID, runs("fl", "v")], FLATLINES_OUT),
    "gaps": GAPS_SQL,
    "gaps_sliced": GAPS_SQL,
    "faults": sql(
        [],
        f"select {ROW_KEYS}, 0.0::double as air_flow_rate, {r6('power_consumption')} as power_consumption from r "
        "where power_consumption > 0 and air_flow_rate < 60",
    ),
    "faults_zero_flow": sql(
        [
            VALID,
            bucketed("h", "v", "1 hour"),
            f"z as (select *, case when {ON} and air_flow_rate < 60 then 1 else 0 end as bad from h)",
            f"zb as (select *, sum(1 - bad) over (partition by {KEYS} order by timestamp rows unbounded preceding) as run from z)",
        ],
        f"""select {KEYS}, 'zero_flow_while_on' as fault, min(timestamp) as "start", max(timestamp) as "end",
  {r6("(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60000000.0")} as minutes, count(*) as readings
  from zb where bad = 1 group by {KEYS}, run
  having count(*) >= 2 and epoch_us(max(timestamp)) - epoch_us(min(timestamp)) >= 3600000000""",
    ),
    "uptime": sql(METRICS, f"select {KEYS}, uptime_seconds from m"),
    "cycles": sql(METRICS, f"select {KEYS}, cycle_count from m"),
    "flow_volume": sql(METRICS, f"select {KEYS}, {r6('total_flow_volume_m3')} as total_flow_volume_m3 from m"),
    "pressure_stats": sql(
        METRICS,
        f"select {KEYS}, {r6('average_pressure_bar')} as average_pressure_bar, {r6('peak_pressure_bar')} as peak_pressure_bar, "
        f"{r6('pressure_std_bar')} as pressure_std_bar, reading_count from m",
    ),
    "specific_power": sql(METRICS, f"select {KEYS}, {r6('specific_power_kw_per_m3h')} as specific_power_kw_per_m3h from m"),
    "thermal": sql(
        METRICS, f"select {KEYS}, {r6('thermal_efficiency_temp_per_kw')} as thermal_efficiency_temp_per_kw from m"
    ),
    "station_window": sql(
        CLEAN,
        "select station_id, min(timestamp) as window_start, max(timestamp) as window_end, count(*) as rows_processed from h group by all",
    ),
    "device_metrics": sql(METRICS, f"select {KEYS}, {METRICS_OUT} from m"),
    "device_metrics_sliced": sql(METRICS, f"select {KEYS}, {METRICS_OUT} from m"),
    "device_metrics_1s": sql(
        [VALID, INTERPOLATED, bucketed("h", "i", "1 second"), metrics("m", "h")], f"select {KEYS}, {METRICS_OUT} from m"
    ),
    "device_metrics_1s_max_gap": sql(
        [VALID, FFILL, bucketed("h", "f", "1 second"), metrics("m", "h", max_gap=1800)],
        f"select {KEYS}, {METRICS_OUT} from m",
    ),
    "device_metrics_ffill": sql(
        [VALID, FFILL, bucketed("h", "f", "1 hour"), metrics("m", "h")], f"select {KEYS}, {METRICS_OUT} from m"
    ),
    "device_metrics_drop": sql(
        [
            VALID,
            "x as (select * from v where " + each("{s} is not null", sep=" and ") + ")",
            bucketed("h", "x", "1 hour"),
            metrics("m", "h"),
        ],
        f"select {KEYS}, {METRICS_OUT} from m",
    ),
    "device_metrics_thresholds": sql(
        [*CLEAN, metrics("m", "h").replace("> 1.0", "> 3200.0").replace("> 0.5", "> 60.0").replace("> 0.001", "> 90.0")],
        f"select {KEYS}, {METRICS_OUT} from m",
    ),
    "contract_json": sql(
        ["o as (select *, discharge_pressure < 2 or discharge_pressure > 6.5 as p, motor_speed < 0 or motor_speed > 3000 as m from r)"],
        """select station_id, count(*) as rows, count(case when p or m then 1 end) as anomaly_rows,
  count(case when p then 1 end) as discharge_pressure, count(case when m then 1 end) as motor_speed,
  count(case when not p then 1 end) as discharge_pressure_kept, count(case when not m then 1 end) as motor_speed_kept
  from o group by station_id""",
    ),
    "device_metrics_max_gap": sql(
        [*CLEAN, metrics("m", "h", max_gap=3600)], f"select {KEYS}, {METRICS_OUT} from m"
    ),
    "metrics_long": sql(
        METRICS,
        " union all ".join(
            f"select {KEYS}, '{m}' as metric, {r6(m)} as value from m where station_id in ('station_0', 'station_2')"
            for m in ("uptime_seconds", "average_pressure_bar", "cycle_count")
        ),
    ),
    "trend_daily": sql(
        [*CLEAN, DAILY_HEALTH],
        f"select {KEYS}, day, uptime_seconds, observed_seconds, {r6('average_pressure_bar')} as average_pressure_bar, "
        f"{r6('uptime_share')} as uptime_share, {r6('pressure_vs_target')} as pressure_vs_target from td",
    ),
    "trend": sql(
        [*CLEAN, DAILY_HEALTH],
        f"""select {KEYS}, count(average_pressure_bar) as days, {r6("sum(uptime_seconds) / sum(observed_seconds)")} as uptime_share,
  {r6("avg(pressure_vs_target)")} as pressure_vs_target,
  {r6("regr_slope(average_pressure_bar, cast(day - date '1970-01-01' as double))")} as pressure_slope_per_day from td group by {KEYS}""",
    ),
    "clean_readings": sql(CLEAN, BUCKETS_OUT + "h"),
    "dq_score": sql(REPORT, "select station_id, round(score, 2) as score from dq"),
    "dq_report": sql(REPORT, REPORT_OUT),
    "dq_report_sliced": sql(REPORT, REPORT_OUT),
    "station_results": sql(
        [
            *METRICS,
            "asked as (select unnest(['station_0', 'station_1', 'station_2', 'station_3', 'station_9']) as station_id)",
            f"""span as (select station_id, {ISO.format(t='min(timestamp)')} as window_start, {ISO.format(t='max(timestamp)')} as window_end,
  count(*) as rows_processed from h group by station_id)""",
            "raw as (select station_id, count(*) as rows_before_clean from r group by station_id)",
        ],
        f"""select asked.station_id, coalesce(window_start, '') as window_start, coalesce(window_end, '') as window_end, rows_processed,
  coalesce(rows_before_clean, 0) as rows_before_clean, device_id, uptime_seconds, {r6('total_flow_volume_m3')} as total_flow_volume_m3
  from asked left join span using (station_id) left join raw using (station_id) left join m using (station_id)""",
    ),
    "busiest_slice": sql(
        [
            "top as (select station_id, count(*) as rows, min(timestamp) as lo, max(timestamp) as hi from r "
            "group by station_id order by rows desc, station_id limit 1)"
        ],
        'select station_id, rows, lo as "start", least(lo + interval \'6 hours\', hi) as "end" from top',
    ),
    "process_receipts": sql(
        REPORT,
        f"""select station_id, {ISO.format(t='min(h.timestamp)')} as window_start, {ISO.format(t='max(h.timestamp)')} as window_end,
  round(max(score), 2) as score from h join dq using (station_id) group by station_id""",
    ),
    "snapshot_upsert": sql(
        CLEAN,
        "select station_id, min(timestamp) as window_start_ts, max(timestamp) as window_end_ts, "
        "timestamp '2024-02-01 02:00:00' as computed_at, count(*) as rows_processed, count(distinct device_id) as devices "
        "from h group by station_id",
    ),
    "snapshot_overlap": sql(
        [VALID, bucketed("h", "v", "1 hour"), f"s as (select *, {DAY} as day from h)"],
        """select * from (select station_id, min(timestamp) as window_start_ts, max(timestamp) as window_end_ts,
  count(*) as rows_processed from s group by station_id, day)
  where window_end_ts >= timestamp '2024-01-10 00:00:00' and window_start_ts <= timestamp '2024-01-12 12:00:00'""",
    ),
    "snapshot_device": sql(
        METRICS,
        " union all ".join(
            f"select 'station_1' as station_id, device_id, '{m}' as metric, {r6(m)} as value from m "
            "where station_id = 'station_1' and device_id = 'compressor_2'"
            for m in (
                "uptime_seconds", "average_pressure_bar", "peak_pressure_bar", "specific_power_kw_per_m3h",
                "cycle_count", "total_flow_volume_m3", "thermal_efficiency_temp_per_kw", "reading_count", "pressure_std_bar",
            )
        ),
    ),
    "incremental_lookback": sql(METRICS, f"select {KEYS}, {METRICS_OUT} from m"),
    "incremental_lookback_ffill": sql(
        [VALID, FFILL, bucketed("h", "f", "1 hour"), metrics("m", "h")], f"select {KEYS}, {METRICS_OUT} from m"
    ),
    "rollup_1d": sql([VALID, bucketed("b", "v", "1 day")], BUCKETS_OUT + "b"),
    "rollup_1w": sql([VALID, bucketed("b", "v", "7 days")], BUCKETS_OUT + "b"),
    "rollup_1mo": sql([VALID, bucketed("b", "v", "1 month")], BUCKETS_OUT + "b"),
    "rollup_window": sql(
        [VALID],
        f"""select {KEYS}, time_bucket(interval '1 day', timestamp) as timestamp, count(*) as rows,
  {each("count({s}) as {s}_n, " + r6("min({s})") + " as {s}_min, " + r6("max({s})") + " as {s}_max")}
  from v where station_id in ('station_1', 'station_3') and timestamp >= timestamp '2024-01-05 06:00:00'
    and timestamp < timestamp '2024-01-20 13:00:00' group by 1, 2, 3""",
    ),
    "rollup_corrected": sql(
        [
            f"rc as (select * replace (case when {DAY} = date '2024-01-10' then motor_speed + 1 else motor_speed end as motor_speed) from r)",
            VALID.replace("from r)", "from rc)"),
            bucketed("b", "v", "1 day"),
            f"late as (select distinct station_id, {DAY} as day from r where timestamp >= timestamp '2024-01-20 06:00:00')",
        ],
        f"""select {BUCKET_KEYS}, {ROUNDED}, {DAY} = date '2024-01-10' or exists (select 1 from late
    where late.station_id = b.station_id and late.day = cast(b.timestamp as date)) as again from b""",
    ),
    "incremental_pending": sql(
        [
            f"""c as (select station_id, {DAY} as period, count(*) as rows,
  count(case when timestamp < timestamp '2024-01-20 06:00:00' then 1 end) as seen from r group by all)"""
        ],
        "select station_id, period, rows from c where rows <> seen",
    ),
    "incremental_corrected": sql(
        [], f"select station_id, {DAY} as period, count(*) as rows from r where {DAY} = date '2024-01-10' group by all"
    ),
    "incremental_reverted": sql(
        [],
        f"""select station_id, {DAY} as period, count(case when {DAY} <> date '2024-01-12' then 1 end) as rows
  from r where {DAY} in (date '2024-01-10', date '2024-01-12') group by all""",
    ),
    "incremental_files": sql(
        [
            f"""c as (select station_id, {DAY} as period, count(*) as rows,
  count(case when timestamp < timestamp '2024-01-20 06:00:00' then 1 end) as seen from r group by all)"""
        ],
        "select station_id, period, rows from c where rows <> seen or period = date '2024-01-10'",
    ),
    "null_rows_whole": NULL_ROWS,
    "null_rows_sliced": NULL_ROWS,
    "dq_report_nulls": sql(
        [SOME_NULL],
        "select station_id, count(*) as rows_before, "
        + ", ".join(
            f"{r6(f'avg(case when {c} is null then 1.0 else 0.0 end)')} as missing_{c}"
            for c in ("station_id", "device_id", "timestamp")
        )
        + " from n0 group by all",
    ),
    "snapshot_late_version": sql(
        [],
        f"""select distinct 'after' as read, station_id, concat('period ', {DAY}) as slot from r
  where timestamp >= timestamp '2024-01-15'""",
    ),
    "read_json_aliases": sql([], ROWS_OUT + "r"),
    "empty_station": """select 'station_99' as station_id, '' as window_start, '' as window_end,
  cast(0 as double) as data_quality_score, 0 as devices""",
    "enriched": sql(
        [
            "seen as (select station_id, count(distinct device_id) as devices_seen, count(*) as rows from r group by all)",
            """st as (select concat('station_', n_nationkey) as station_id, n_name as station_name, r_name as location,
  date '2020-01-01' + n_nationkey as commissioned_date, cast(n_nationkey % 12 as bigint) as num_compressors
  from nation join region on n_regionkey = r_regionkey)""",
        ],
        """select station_id, station_name, location, commissioned_date, num_compressors, coalesce(devices_seen, 0) as devices_seen,
  coalesce(rows, 0) as rows, coalesce(num_compressors between 1 and 10, false) as declared_valid,
  coalesce(num_compressors = coalesce(devices_seen, 0), false) as count_matches from st full join seen using (station_id)""",
    ),
    "stream_dead_letter": sql(
        [],
        f"""select cast(event_id as varchar) as event_id,
  case event_id % 50 when 0 then 'missing_field' when 1 then 'bad_type' else 'corrupt' end as reason
  from r, unnest(range({COPIES})) where not ({GOOD})""",
    ),
    "stream_dedupe": sql(
        [],
        f"select cast(event_id as varchar) as event_id, timestamp, station_id, device_id, {ROUNDED} from r where {GOOD}",
    ),
    "stream_windows": sql(
        [
            f"g as (select * from r where {GOOD})",
            "w as (select *, time_bucket(interval '1 hour', timestamp) as bucket from g)",
        ],
        f"""select station_id, device_id, bucket as timestamp, count(*) as readings, count(case when {ANY_BAD} then 1 end) as anomaly_rows,
  {each('round(avg(case when not ' + BAD + ' then {s} end) + 1e-10, 6) as {s}')},
  {each('count(case when ' + BAD + ' then 1 end) as oor_{s}')},
  {each('round(avg(cast({s} is null as int)) + 1e-10, 6) as missing_{s}')}
  from w where bucket + interval '1 hour' <= (select max(timestamp) - interval '10 minutes' from g)
  group by station_id, device_id, bucket""",
    ),
    "stream_long": sql(
        [],
        " union all ".join(
            f"select station_id, '{s}' as sensor, cast(sum({COPIES}) as bigint) as readings, "
            f"cast(sum(case when {s} is not null then {COPIES} else 0 end) as bigint) as \"values\" from r where {GOOD} group by station_id"
            for s in SENSORS
        ),
    ),
    "stream_status": sql(
        [],
        f"""select cast(sum({COPIES}) as bigint) as received, cast(sum(case when {GOOD} then {COPIES} else 0 end) as bigint) as processed,
  cast(sum(case when {GOOD} then 0 else {COPIES} end) as bigint) as errors,
  cast(sum(case when event_id % 50 = 0 then {COPIES} else 0 end) as bigint) as missing_field,
  cast(sum(case when event_id % 50 = 1 then {COPIES} else 0 end) as bigint) as bad_type,
  cast(sum(case when event_id % 50 = 2 then {COPIES} else 0 end) as bigint) as corrupt,
  max(case when {GOOD} then timestamp end) as last_event_at from r""",
    ),
    "stream_snapshots": sql(SPLIT_DAYS, DAY_METRICS_OUT),
    "stream_lookback": sql(
        [*GOOD_DAYS, INTERPOLATED, HOURLY, metrics("m", "h")], f"select {KEYS}, {METRICS_OUT} from m"
    ),
    "stream_replay": sql(
        SPLIT_DAYS, DAY_METRICS_OUT + " where day between date '2024-01-08' and date '2024-01-09'"
    ),
    "stream_compacted": sql(
        SPLIT_DAYS, DAY_METRICS_OUT + " where day between date '2024-01-08' and date '2024-01-09'"
    ),
    "stream_late": sql(
        [f"g as (select * from r where {GOOD})"],
        f"""select station_id, {DAY} as period, cast(sum({COPIES}) as bigint) as events from g
  where timestamp < timestamp '2024-01-20 06:00:00' and timestamp < (select max(timestamp) - interval '1 hour' from g)
  group by all""",
    ),
    "stream_batch_log": sql(
        [
            "b as (select *, case when timestamp < timestamp '2024-01-20 06:00:00' then 1 else 0 end as batch_id from r)",
            f"newest as (select max(timestamp) as top_at from b where batch_id = 0 and {GOOD})",
        ],
        f"""select cast(batch_id as bigint) as batch_id, cast(sum({COPIES}) as bigint) as received,
  cast(sum(case when {GOOD} then {COPIES} else 0 end) as bigint) as processed,
  cast(sum(case when {GOOD} then 0 else {COPIES} end) as bigint) as errors,
  cast(sum(case when {GOOD} and batch_id = 1 and timestamp < top_at - interval '1 hour' then {COPIES} else 0 end) as bigint) as late,
  max(case when {GOOD} then timestamp end) as last_event_at, any_value(top_at) as newest_event_at,
  any_value(case when batch_id = 1 then top_at - interval '1 hour' end) as watermark
  from b, newest group by batch_id""",
    ),
    "stream_late_replay": sql(SPLIT_DAYS, DAY_METRICS_OUT),
}

BUSIEST = [
    "top as (select station_id as sid, count(*) as rows, min(timestamp) as lo, max(timestamp) as hi from r "
    "group by station_id order by rows desc, sid limit 1)",
    f"sl as (select {ROW_KEYS}, {', '.join(SENSORS)} from r join top on station_id = sid "
    "where timestamp between lo and least(lo + interval '6 hours', hi))",
    VALID.replace("from r", "from sl"),
    INTERPOLATED,
    HOURLY,
    metrics("m", "h"),
]
ORACLE["busiest_run"] = sql(
    BUSIEST,
    f"select {KEYS}, reading_count, uptime_seconds, {r6('average_pressure_bar')} as average_pressure_bar from m",
)
