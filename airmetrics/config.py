"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class MissingData(str, Enum):
    """What to do with gaps left after range validation, per device."""

    DROP = "drop"
    FFILL = "ffill"
    INTERPOLATE = "interpolate"
    FILL = "fill"

    @classmethod
    def parse(cls, value: str | MissingData, strict: bool = True) -> MissingData:
        """Unknown names raise; with ``strict=False`` they mean ``interpolate``."""
        try:
            return cls(value)
        except ValueError:
            if strict:
                raise
            return cls.INTERPOLATE


@dataclass(frozen=True)
class PipelineConfig:
    """Tuning of a run; the defaults suit five-minute compressor data.

    ``chunk`` bounds how much of one device's history a task may hold: ``"auto"`` measures the
    input first, a rule such as ``"1d"`` fixes the slice width, ``None`` keeps each device whole.
    ``max_gap_seconds`` stops uptime and volume from integrating over longer silences.
    """

    resample_rule: str = "5min"
    missing_strategy: MissingData | str = MissingData.INTERPOLATE
    motor_on_threshold_rpm: float = 1.0
    power_on_threshold_kw: float = 0.5
    flow_epsilon_m3h: float = 1e-3
    interpolate_by: str = "row"
    fill_values: dict[str, float] = field(default_factory=dict)
    max_gap_seconds: int | None = None
    fill_grid: bool = False
    chunk: str | None = "auto"
    strict: bool = True

    @property
    def strategy(self) -> MissingData:
        return MissingData.parse(self.missing_strategy, self.strict)
