"""A Bloom filter as a relation of set bits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions.text import hash32


def bits_for(n: int, fp_rate: float) -> int:
    return int(-n * math.log(fp_rate) / math.log(2) ** 2)


def hashes_for(m: int, n: int) -> int:
    return max(1, int(m / n * math.log(2)))


def expected_fp(m: int, k: int, count: int) -> float:
    return (1 - math.exp(-k * count / m)) ** k


def memory_bytes(m: int) -> int:
    return m // 8


def positions(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """Adds pos: k rows for each item."""
    places = F.array(*(F.pmod(hash32(F.col(column), i), F.lit(m)) for i in range(k)))
    return items.withColumn("pos", F.explode(places))


def build(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The set bits: pos. At most m rows leave the map side of each task."""
    return positions(items.select(column).distinct(), column, m, k).select("pos").distinct()


def contains(probes: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """column and maybe (in the filter, with its false positives) of every distinct probe."""
    asked = positions(probes.select(column).distinct(), column, m, k).distinct()
    found = asked.join(bits.withColumn("_set", F.lit(1)), "pos", "left")
    return found.groupBy(column).agg((F.count("*") == F.count("_set")).alias("maybe"))


def fill_ratio(bits: DataFrame, m: int) -> DataFrame:
    return bits.agg(F.count("*").alias("bits_set"), (F.count("*") / F.lit(float(m))).alias("fill_ratio"))


def native_filter(items: DataFrame, column: str, n: int, fp_rate: float):
    """Spark's own sketch on the driver (its size depends on n and fp_rate only)."""
    return items._jdf.stat().bloomFilter(column, n, fp_rate)
