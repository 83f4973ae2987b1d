"""Range validation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from airmetrics.contract import Contract


def null_out_of_range(df: DataFrame, contract: Contract) -> DataFrame:
    """Replace out-of-range sensor values by NULL; rows stay."""
    return df.withColumns({s: contract.in_range(s) for s in contract.sensors})
