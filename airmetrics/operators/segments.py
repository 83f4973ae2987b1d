"""Metrics as summaries of time segments that add up.

A summary holds what happened inside one segment of a series: its first and last sample, and sums.
Two neighbouring summaries make one: sums are added, and what lies between the last sample of the
one and the first of the other (elapsed time, a switch to on, a trapezoid of flow) comes on top. The
step is associative, so segments can be stored, combined over any range and in a tree. No window
ever reaches across a segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.config import PipelineConfig
from airmetrics.functions.time import DAY, HOUR, MINUTE, SECOND, Rule, time_bucket
from airmetrics.operators.metrics import FLOW, POWER, PRESSURE, TEMPERATURE, is_on_sql, metric_aggregates, previous_values
from airmetrics.operators.series import TIE, Layout

#: A sample at the edge of a segment.
EDGE = "struct<timestamp:timestamp,tie:bigint,on:boolean,flow:double>"
SUMS = (
    "uptime", "switches", "volume", "readings", "pressure_n", "pressure_sum", "pressure_square", "pressure_spread",
    "ratio_n", "ratio_sum", "temp_n", "temp_sum", "power_n", "power_sum",
)
#: Samples that one segment holds at most, on its grid.
SEGMENT_SAMPLES = 100_000
#: Levels of the tree; a node has at most 3600 children but for the last level, which has months.
LEVELS = ((MINUTE, "1min"), (HOUR, "1h"), (DAY, "1d"), (31 * DAY, "1mo"))


def segment_width(rule: Rule) -> int:
    """The widest of day, hour, minute and second that holds few enough buckets, in microseconds."""
    for width in (DAY, HOUR, MINUTE, SECOND):
        if rule.divides(width) and width <= SEGMENT_SAMPLES * rule.width_us:
            return width
    raise ValueError(f"buckets of {rule.text!r} do not fill a second, minute, hour or day")


def summaries(
    rows: DataFrame, config: PipelineConfig, layout: Layout, counted: str = "true", sums: Sequence[str] = ()
) -> DataFrame:
    """One summary per segment of ``layout``: ``first``, ``last``, :data:`SUMS`, and the sums asked for.

    ``counted`` selects the rows that are readings; the others only add to ``sums``.
    """
    rows = layout.spread(rows).withColumn("_counted", F.expr(counted))
    window = Window.partitionBy(*layout.partition, "_counted").orderBy("timestamp", TIE)
    rows = rows.withColumns({f"prev_{n}": F.lag(v).over(window) for n, v in previous_values(config).items()})
    # Outside readings nothing counts.
    used = ("prev_timestamp", "prev_on", "prev_flow", PRESSURE, FLOW, POWER, TEMPERATURE, "motor_speed")
    own = rows.withColumns({c: F.when(F.col("_counted"), F.col(c)) for c in used})
    metrics = metric_aggregates(config, "_counted")
    edge = f"named_struct('timestamp', timestamp, 'tie', {TIE}, 'on', {is_on_sql(config)}, 'flow', {FLOW})"
    powered = f"CASE WHEN {POWER} > {float(config.power_on_threshold_kw)}D THEN"
    ratio = f"try_divide({POWER}, CASE WHEN abs({FLOW}) > {float(config.flow_epsilon_m3h)!r}D THEN {FLOW} END)"
    ratio = f"CASE WHEN NOT isnan({ratio}) AND abs({ratio}) < double('Infinity') THEN {ratio} END"
    totals = {
        "readings": "count(CASE WHEN _counted THEN 1 END)",
        # The first sample has no sample before it here; whether it is a switch shows when segments meet.
        "switches": f"count(CASE WHEN {is_on_sql(config)} AND NOT prev_on THEN 1 END)",
        "pressure_n": f"count({PRESSURE})",
        "pressure_sum": f"coalesce(sum({PRESSURE}), 0D)",
        "pressure_square": f"coalesce(count({PRESSURE}) * pow(avg({PRESSURE}), 2), 0D)",
        "pressure_spread": f"coalesce(var_pop({PRESSURE}) * count({PRESSURE}), 0D)",
        "ratio_n": f"count({ratio})",
        "ratio_sum": f"coalesce(sum({ratio}), 0D)",
        "temp_n": f"count({powered} {TEMPERATURE} END)",
        "temp_sum": f"coalesce(sum({powered} {TEMPERATURE} END), 0D)",
        "power_n": f"count({powered} {POWER} END)",
        "power_sum": f"coalesce(sum({powered} {POWER} END), 0D)",
    }
    return own.groupBy(*layout.partition).agg(
        *[F.expr(f"{pick}(CASE WHEN _counted THEN {edge} END)").cast(EDGE).alias(end) for end, pick in (("first", "min"), ("last", "max"))],
        metrics["uptime_seconds"].alias("uptime"),
        metrics["total_flow_volume_m3"].alias("volume"),
        *[F.expr(text).alias(n) for n, text in totals.items()],
        F.max(PRESSURE).alias("pressure_max"),
        *[F.sum(c).alias(c) for c in sums],
    )


def _meeting(config: PipelineConfig) -> dict[str, str]:
    """What the time between two neighbouring edges ``p.a`` and ``p.b`` adds."""
    elapsed = f"((unix_micros(p.b.timestamp) - unix_micros(p.a.timestamp)) div {SECOND})"
    near = "true" if config.max_gap_seconds is None else f"{elapsed} <= {int(config.max_gap_seconds)}"
    return {
        "uptime": f"CASE WHEN p.a.on AND p.b.on AND {near} THEN {elapsed} ELSE 0L END",
        "switches": "CASE WHEN p.b.on AND NOT p.a.on THEN 1L ELSE 0L END",
        "volume": f"coalesce(CASE WHEN {near} THEN (p.a.flow + p.b.flow) / 2 * ({elapsed} / 3600D) END, 0D)",
    }


def combine(parts: DataFrame, keys: Sequence[str], config: PipelineConfig, sums: Sequence[str] = ()) -> DataFrame:
    """Join the summaries of each key in the order of time; the result is a summary again."""
    ends = F.when(F.col("first").isNotNull(), F.struct("first", "last"))
    joined = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(ends)).alias("_ends"),
        *[F.sum(c).alias(c) for c in (*SUMS, *sums)],
        F.max("pressure_max").alias("pressure_max"),
    )
    inner = "greatest(size(_ends) - 1, 0)"
    pairs = f"zip_with(slice(_ends, 1, {inner}), slice(_ends, 2, {inner}), (x, y) -> named_struct('a', x.last, 'b', y.first))"
    joined = joined.withColumn("_pairs", F.expr(pairs))
    added = {
        name: F.expr(f"{name} + aggregate(_pairs, {'0D' if name == 'volume' else '0L'}, (total, p) -> total + {what})")
        for name, what in _meeting(config).items()
    }
    ends = {"first": F.expr("get(_ends, 0).first"), "last": F.expr("get(_ends, size(_ends) - 1).last")}
    return joined.withColumns(added).withColumns(ends).drop("_ends", "_pairs")


def combine_all(
    parts: DataFrame, keys: Sequence[str], config: PipelineConfig, width_us: int, sums: Sequence[str] = ()
) -> DataFrame:
    """One summary per key, in a tree over the calendar; ``width_us`` is the width of the parts."""
    for width, rule in LEVELS:
        if width > width_us:
            # A part without readings has sums all the same: it goes with those of no time.
            at = time_bucket(F.col("first.timestamp"), rule).alias("_node")
            parts = combine(parts.withColumn("_node", at), [*keys, "_node"], config, sums)
    return combine(parts, keys, config, sums)


def metrics_of(whole: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The nine metrics of complete summaries; a series that begins on has its first cycle there."""
    spread = "greatest(pressure_spread + pressure_square - pow(pressure_sum, 2) / pressure_n, 0D)"
    texts = {
        "uptime_seconds": "uptime",
        "average_pressure_bar": "try_divide(pressure_sum, pressure_n)",
        "peak_pressure_bar": "pressure_max",
        "specific_power_kw_per_m3h": "try_divide(ratio_sum, ratio_n)",
        "cycle_count": "switches + CASE WHEN first.on THEN 1L ELSE 0L END",
        "total_flow_volume_m3": "volume",
        "thermal_efficiency_temp_per_kw": "try_divide(try_divide(temp_sum, temp_n), try_divide(power_sum, power_n))",
        "reading_count": "readings",
        "pressure_std_bar": f"CASE WHEN pressure_n > 1 THEN sqrt({spread} / (pressure_n - 1)) END",
    }
    return whole.select(*keys, *[F.expr(text).alias(n) for n, text in texts.items()], *extra)

