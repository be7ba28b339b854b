"""Count-Min Sketch as a relation of cells, exact counts and top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.text import hash32


def width_for(epsilon: float) -> int:
    return math.ceil(math.e / epsilon)


def depth_for(delta: float) -> int:
    return math.ceil(math.log(1 / delta))


def memory_bytes(width: int, depth: int) -> int:
    return width * depth * 8


def cells(column: str, width: int, depth: int) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(hash32(F.col(column), r), F.lit(width)).alias("col")) for r in range(depth))))


def sketch(events: DataFrame, column: str, width: int, depth: int, weight: Column | None = None) -> DataFrame:
    """row, col, cnt. Items are summed before they are hashed, cells before they are shuffled."""
    weight = F.lit(1) if weight is None else weight
    per_item = events.groupBy(column).agg(F.sum(weight).cast("long").alias("_n"))
    hit = per_item.select("_n", cells(column, width, depth).alias("c"))
    return hit.groupBy("c.row", "c.col").agg(F.sum("_n").alias("cnt"))


def estimate(items: DataFrame, column: str, table: DataFrame, width: int, depth: int) -> DataFrame:
    """column and estimate of every distinct item; 0 where a cell is empty."""
    asked = items.select(column).distinct().select(column, cells(column, width, depth).alias("c")).select(column, "c.*")
    return asked.join(table, ["row", "col"], "left").groupBy(column).agg(F.min(F.coalesce("cnt", F.lit(0).cast("long"))).alias("estimate"))


def exact(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("cnt"))


def top_k(events: DataFrame, column: str, k: int, weight: Column | None = None) -> DataFrame:
    """The k most frequent items, ties by item: a heap of k in each task, no global sort."""
    weight = F.lit(1) if weight is None else weight
    counts = events.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(weight).cast("long").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), column).limit(k)


def approximate_top_k(events: DataFrame, column: str, k: int, tracked: int = 10_000) -> DataFrame:
    """Spark's frequent-items sketch, ties by item; exact up to ``tracked`` different items."""
    found = events.agg(F.expr(f"approx_top_k({column}, {tracked}, {tracked})").alias("top")).select(F.explode("top").alias("t"))
    return found.select(F.col("t.item").alias(column), F.col("t.count").alias("cnt")).orderBy(F.desc("cnt"), column).limit(k)


def relative_error(estimates: DataFrame, truth: DataFrame, column: str) -> DataFrame:
    both = estimates.join(truth, column)
    return both.withColumn("error", F.abs(F.col("estimate") - F.col("cnt")).cast("double") / F.greatest("cnt", F.lit(1)))
