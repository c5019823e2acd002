"""Dense unique numbers of keys, and the bucket mappers of perfect hashing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered


class Collision(ValueError):
    """A key comes twice."""


class BucketOverflow(ValueError):
    """A bucket holds too many keys."""


@dataclass
class Config:
    """Sizes of a table for n keys. minimal: slots are 0..n-1, as they are here at any rate; cache_size has no effect on results."""

    n: int
    lam: float = 6.0
    alpha: float = 0.97
    minimal: bool = False
    num_buckets: int | None = None
    cache_size: int = 4096
    max_bucket: int = 1024

    @property
    def buckets(self) -> int:
        return int(self.n / self.lam) if self.num_buckets is None else self.num_buckets

    @property
    def table_size(self) -> int:
        size = math.ceil(self.n / self.alpha + 1)
        return size + (size & (size - 1) == 0)

    @property
    def size(self) -> int:
        """Numbers that a key can get."""
        return self.n if self.minimal else self.table_size

    @property
    def eps(self) -> float:
        """The even share that the optimal mapper is mixed with."""
        return max(0.0, min(1.0, self.max_bucket / (5.0 * math.sqrt(self.n)))) if self.n else 1.0


def collisions(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, times) of the keys that come more than once."""
    return keys.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def assign(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, slot): a bijection from the keys to 0..n-1 in the order of keys; raises Collision if one comes twice."""
    twice = collisions(keys, key).limit(1).collect()
    if twice:
        raise Collision(str(twice[0][0]))
    return numbered(keys.select(key), key, name="slot").select(key, "slot")


def get(table: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """The slots of probes; null for others than the keys."""
    return probes.join(table, key, "left").select(key, "slot")


def skewed_bucket(u: Column, buckets: int, a: float = 0.3, b: float = 0.6) -> Column:
    """u in [0, 1): the share b of keys goes to the share a of buckets."""
    dense = math.floor(a * buckets)
    if dense < 1 or dense >= buckets:
        return F.floor(u * buckets).cast("long")
    return F.when(u < b, F.floor(u / b * dense)).otherwise(dense + F.floor((u - b) / (1 - b) * (buckets - dense))).cast("long")


def optimal_bucket(u: Column, buckets: int, eps: float = 0.0) -> Column:
    """floor(beta(u) * buckets), beta(u) = u + (1 - u) ln(1 - u), mixed with eps * u."""
    beta = F.when(u >= 1, F.lit(1.0)).otherwise(u + (1 - u) * F.ln(1 - u))
    return F.least(F.floor((eps * u + (1 - eps) * beta) * buckets), F.lit(buckets - 1)).cast("long")


def unit_hash(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the upper 53 bits of a seeded 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / float(1 << 53)


def bucketed(keys: DataFrame, config: Config, mapper: str = "optimal", key: str = "key", seed: int = 0) -> DataFrame:
    """(key, bucket) by hash and mapper (optimal or skewed); raises BucketOverflow if one bucket would hold max_bucket keys or more."""
    u, n = unit_hash(F.col(key), seed), max(config.buckets, 1)
    out = keys.select(key, (optimal_bucket(u, n, config.eps) if mapper == "optimal" else skewed_bucket(u, n)).alias("bucket"))
    over = out.groupBy("bucket").agg(F.count("*").alias("held")).where(F.col("held") >= config.max_bucket).limit(1).collect()
    if over:
        raise BucketOverflow(f"bucket {over[0]['bucket']}: {over[0]['held']} keys")
    return out
