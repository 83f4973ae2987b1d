"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airmetrics.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("child", "parent") % (1 << 31)).alias("h")).first()
    return row.n, row.h or 0


def components(edges: DataFrame) -> DataFrame:
    """``child`` and ``parent`` (the least member) for every node that is not its own least member.

    ``edges`` has columns ``a`` and ``b`` of one type. Rounds grow with the logarithm of the
    longest path; each is written to the shared folder. Nodes without an edge are not listed.
    """
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    now = stored(ordered.distinct(), "edges")
    state = _state(now)
    while True:
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
            now.select(F.col("parent").alias("u"), F.col("child").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent"))
        large = stored(large.distinct(), "edges")
        least = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = large.join(least, "child").where("parent != m").select(
            F.col("parent").alias("child"), F.col("m").alias("parent")
        )
        now = stored(small.unionByName(least.withColumnRenamed("m", "parent")).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            return now
