"""Time expressions: bucket rules, whole-second differences, ISO text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY

# The unit suffixes a bucket rule may carry.
FIXED_UNITS = {
    "us": 1,
    "ms": 1_000,
    "s": SECOND,
    "m": MINUTE,
    "min": MINUTE,
    "h": HOUR,
    "d": DAY,
    "w": WEEK,
}
MONTH_UNITS = {"mo": 1, "q": 3, "y": 12}

# 1970-01-05 is the first Monday after the epoch: weekly buckets start on Mondays.
MONDAY = 4 * DAY

_TOKEN = re.compile(r"(\d+)\s*([a-z]+)")


@dataclass(frozen=True)
class Rule:
    """A tumbling bucket: a fixed width in microseconds, or a number of months."""

    text: str
    width_us: int = 0
    months: int = 0

    @property
    def origin_us(self) -> int:
        return MONDAY if self.width_us and self.width_us % WEEK == 0 else 0

    def interval(self) -> str:
        """Interval text for ``F.window`` (fixed widths only)."""
        if self.months:
            raise ValueError(f"{self.text!r} has no fixed width")
        return f"{self.width_us} microseconds"

    def divides(self, width_us: int) -> bool:
        """True when every bucket lies inside one epoch-aligned slice of ``width_us``."""
        return bool(self.width_us) and self.origin_us == 0 and width_us % self.width_us == 0


def parse_rule(rule: str | Rule) -> Rule:
    """``5min``, ``1h``, ``1d12h``, ``2w``, ``1mo`` ... to a :class:`Rule`."""
    if isinstance(rule, Rule):
        return rule
    text = rule.strip().lower()
    tokens = _TOKEN.findall(text)
    if not tokens or "".join(n + u for n, u in tokens) != re.sub(r"\s", "", text):
        raise ValueError(f"unknown bucket rule: {rule!r}")
    width = months = 0
    for number, unit in tokens:
        if unit in FIXED_UNITS:
            width += int(number) * FIXED_UNITS[unit]
        elif unit in MONTH_UNITS:
            months += int(number) * MONTH_UNITS[unit]
        else:
            raise ValueError(f"unknown unit {unit!r} in bucket rule {rule!r}")
    if bool(width) == bool(months):
        raise ValueError(f"bucket rule must be one positive fixed or calendar width: {rule!r}")
    return Rule(text, width, months)


def floor_us(ts: Column, width_us: int, origin_us: int = 0) -> Column:
    """Microseconds since the epoch of the slice start that holds ``ts``."""
    us = F.unix_micros(ts)
    return us - F.pmod(us - F.lit(origin_us), F.lit(width_us))


def time_bucket(ts: Column | str, rule: str | Rule) -> Column:
    """Start of the left-closed, epoch-aligned bucket that holds ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    r = parse_rule(rule)
    if r.months == 0:
        return F.timestamp_micros(floor_us(ts, r.width_us, r.origin_us))
    month = F.date_trunc("month", ts)
    if r.months == 1:
        return month
    surplus = F.pmod(F.year(ts) * 12 + F.month(ts) - 1, F.lit(r.months))
    return F.date_trunc("month", F.add_months(month, -surplus).cast("timestamp"))


def whole_seconds(start: Column, end: Column) -> Column:
    """Elapsed time in seconds, the fraction cut off."""
    return F.call_function("div", F.unix_micros(end) - F.unix_micros(start), F.lit(SECOND))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MINUTE))


def iso_text(ts: Column) -> Column:
    """UTC ISO 8601 text; the fraction appears only when there is one. NULL gives ''."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    has_fraction = F.pmod(F.unix_micros(ts), F.lit(SECOND)) != 0
    return F.coalesce(F.concat(F.when(has_fraction, fine).otherwise(whole), F.lit("+00:00")), F.lit(""))


def parse_bound(value: str | datetime | None) -> datetime | None:
    """One side of a time window: empty means open, text must be ISO 8601 (``Z`` accepted)."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as e:
            raise ValueError(f"invalid datetime: {value}") from e
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def bound_literal(value: str | datetime | None) -> Column | None:
    """A bound as a timestamp literal that can be pushed down to the scan."""
    parsed = parse_bound(value)
    return None if parsed is None else F.lit(parsed)
