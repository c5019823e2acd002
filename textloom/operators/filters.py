"""Approximate membership and recency: Bloom filters as tables of bits, and the hits of a least-recently-used cache."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .tables import materialised


def bloom_bits(n: int, p: float) -> int:
    return max(1, math.floor(-n * math.log(p) / math.log(2) ** 2))


def bloom_bytes(n: int, p: float) -> int:
    return -(-bloom_bits(n, p) // 8)


def bloom_hashes(n: int, p: float) -> int:
    return max(1, math.floor(bloom_bits(n, p) / n * math.log(2)))


def places(key: Column, bits: int, hashes: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(k), key), F.lit(bits)) for k in range(hashes)]))


def bloom_build(keys: DataFrame, key: str, n: int, p: float = 0.01) -> DataFrame:
    """(bucket, bitmap): the filter's bits in pieces, each made by partial aggregation; for a filter of any size."""
    at = keys.select(F.explode(places(F.col(key), bloom_bits(n, p), bloom_hashes(n, p))).alias("b"))
    return at.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bitmap"))


def bloom_contains(filter_: DataFrame, probes: DataFrame, key: str, n: int, p: float = 0.01) -> DataFrame:
    """probes' distinct keys with `maybe`: false is certain."""
    k = F.col(key)
    asked = probes.select(key).distinct().select(key, F.size(places(k, bloom_bits(n, p), bloom_hashes(n, p))).alias("wanted"), F.explode(places(k, bloom_bits(n, p), bloom_hashes(n, p))).alias("b"))
    at = F.bitmap_bit_position("b")
    byte = F.conv(F.hex(F.call_function("substring", F.col("bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(byte, (at % 8).cast("int"))
    met = asked.join(filter_, F.bitmap_bucket_number("b") == F.col("bucket"), "left").groupBy(key, "wanted").agg(F.sum(F.coalesce(hit.cast("int"), F.lit(0))).alias("found"))
    return met.select(key, (F.col("found") == F.col("wanted")).alias("maybe"))


def recent_hits(keys: list, recent: dict, capacity: int) -> list[bool]:
    """Whether each key is among the `capacity` used last; recent holds them in order of use and is carried on."""
    hits = []
    for k in keys:
        hits.append(k in recent)
        recent.pop(k, None)
        recent[k] = None
        if len(recent) > capacity:
            recent.pop(next(iter(recent)))
    return hits


def lru_hits(events: DataFrame, by: str, order: str, key: str, capacity: int) -> DataFrame:
    """by, order, key, hit: whether the key is among the `capacity` keys used last in its group; equal `order` is taken by key.

    Events are put in ranges of (by, order), so that a hot group is dealt out too. All that a range needs of those before are the last `capacity` keys of the group that it begins in the
    middle of, of which each range before gives at most `capacity`."""
    import pandas as pd

    rows = events.select(F.col(by).alias("g"), F.col(order).alias("o"), F.col(key).alias("k"))
    ranged = materialised(rows.repartitionByRange("g", "o").withColumn("r", F.spark_partition_id()), "ranges")
    bounds = ranged.groupBy("r").agg(F.min("g").alias("first"), F.max("g").alias("last"), F.count_if(F.col("g").isNull()).alias("nulls"))
    # null groups sort first: a range that holds some begins with them
    bounds = bounds.select("r", F.when(F.col("nulls") > 0, F.lit(None)).otherwise(F.col("first")).alias("first"), "last")
    uses = ranged.groupBy("r", "g", "k").agg(F.max("o").alias("o"))
    tails = uses.join(F.broadcast(bounds), "r").where(F.col("g").eqNullSafe(F.col("last")))
    newest = W.Window.partitionBy("r").orderBy(F.desc("o"), F.desc("k"))
    tails = tails.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= capacity).select("r", "g", "k", "o")
    starts = bounds.select(F.col("r").alias("to"), "first")
    carried = tails.join(F.broadcast(starts), (F.col("r") < F.col("to")) & F.col("g").eqNullSafe(F.col("first"))).select("to", F.col("k").alias("kb"), F.col("o").alias("ob"))

    def run(now: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        now = now.sort_values(["g", "o", "k"], na_position="first", kind="stable")
        before = before.sort_values(["ob", "kb"], na_position="first", kind="stable").drop_duplicates("kb", keep="last")
        recent, hits = dict.fromkeys(before["kb"].tolist()[-capacity:]), []
        for _, group in now.groupby("g", sort=False, dropna=False):
            hits += recent_hits(group["k"].tolist(), recent, capacity)
            recent = {}
        return now[["g", "o", "k"]].assign(hit=hits)

    schema = ", ".join(f"{n} {events.schema[c].dataType.simpleString()}" for n, c in (("g", by), ("o", order), ("k", key))) + ", hit boolean"
    done = ranged.groupBy("r").cogroup(carried.groupBy("to")).applyInPandas(run, schema)
    return done.select(F.col("g").alias(by), F.col("o").alias(order), F.col("k").alias(key), "hit")
