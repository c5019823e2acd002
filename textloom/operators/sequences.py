"""Ordered integer sequences (ord, value): access by position, differences, prefix sums, next greater or equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .tables import materialised, numbered, running


def build(df: DataFrame, value: str, *order: str) -> DataFrame:
    """(ord, value) from 0 in the given order."""
    return numbered(df.select(*dict.fromkeys([*order, value])), *order).select("ord", F.col(value).cast("long").alias("value"))


def decreasing(seq: DataFrame) -> DataFrame:
    """Rows below the one before: a monotone sequence has none. Neighbours meet by equi-join on the position."""
    before = seq.select((F.col("ord") + 1).alias("ord"), F.col("value").alias("previous"))
    return seq.join(before, "ord").where("value < previous")


def get(seq: DataFrame, positions: DataFrame) -> DataFrame:
    """positions: ord -> ord, value; null outside of the sequence."""
    return positions.join(seq, "ord", "left").select("ord", "value")


def diff(seq: DataFrame) -> DataFrame:
    """(ord, diff): the next value less this one."""
    after = seq.select((F.col("ord") - 1).alias("ord"), F.col("value").alias("next"))
    return seq.join(after, "ord").select("ord", (F.col("next") - F.col("value")).alias("diff"))


def prefix_sum(seq: DataFrame) -> DataFrame:
    return running(seq, "ord", "value", "total").select("ord", "total")


def next_geq(seq: DataFrame, probes: DataFrame, parts: int | None = None) -> DataFrame:
    """probes: x -> x, value: the smallest value >= x, or null. Distinct values and probes are put in ranges of about equal numbers of rows, `parts` of them (by default as many as shuffles
    have), however dense the values lie. A probe looks in its own range, and beyond it takes the least value of the next range that has any: one row a range."""
    both = seq.select(F.col("value").alias("at")).distinct().withColumn("v", F.col("at")).unionByName(probes.select(F.col("x").alias("at")).distinct().withColumn("v", F.lit(None).cast("long")))
    ranged = both.repartitionByRange(parts, "at") if parts else both.repartitionByRange("at")
    ranged = materialised(ranged.withColumn("r", F.spark_partition_id()), "ranges")
    # from the largest down, values ahead of equal probes: a frame that only grows costs one step a row, one that only shrinks is summed anew for each
    inside = W.Window.partitionBy("r").orderBy(F.desc("at"), F.col("v").isNull()).rowsBetween(W.Window.unboundedPreceding, 0)
    near = ranged.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("v is null")
    least = ranged.groupBy("r").agg(F.min("v").alias("least"))
    beyond = least.select("r", F.min("least").over(W.Window.orderBy(F.desc("r")).rowsBetween(W.Window.unboundedPreceding, -1)).alias("beyond"))
    return near.join(F.broadcast(beyond), "r").select(F.col("at").alias("x"), F.coalesce("own", "beyond").alias("value"))


def encoded_bits(n: int, universe: int) -> int:
    """Bits of the high-low encoding of n values below universe."""
    if not n or not universe:
        return 0
    low = max(0, (universe - 1).bit_length() - (n - 1).bit_length())
    return n * low + (universe >> low) + n
