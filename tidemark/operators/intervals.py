"""Intervals in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of starts that are unified together before all are.
_CHUNK = 1 << 20


def unify_intervals(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) with overlapping or touching intervals of a key made one; null bounds are open ends.

    First within chunks of time, which is most of the work and spreads over tasks, then over the rests.
    """
    lo, hi = F.coalesce("start", F.lit(-(1 << 62))), F.coalesce("end", F.lit(1 << 62))
    ranges = log.select(*keys, lo.alias("start"), hi.alias("end"))
    local = _unified(ranges.withColumn("chunk", F.floor(F.col("start") / _CHUNK)), [*keys, "chunk"]).drop("chunk")
    return _unified(local if keys else local.withColumn("all", F.lit(0)), keys or ["all"]).select(*keys, "start", "end")


def _unified(ranges: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = ranges.withColumn("gap", F.coalesce((F.col("start") > seen).cast("int"), F.lit(1)))
    groups = gaps.withColumn("g", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(*keys, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")
