"""Connected components by alternating star joins, nothing by node on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _mark(edges: DataFrame) -> tuple:
    h = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.sum(h)).collect()[0])


def components(edges: DataFrame, nodes: int | None = None, most_rounds: int = 50) -> DataFrame:
    """c, root of every node in ``edges`` (a, b: long); root is the least node of the component.
    ``nodes``: no more than so many, if that is known.

    Large star: every greater neighbour of a node is hung on the node's least neighbour; small
    star: so are its lesser neighbours and itself. Minima are combined before the shuffle, and
    the joins on nodes with many edges are ones that Spark may split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", nodes)
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges", nodes)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hung.unionByName(low.withColumnRenamed("m", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        last, now = now, written(small.distinct(), "edges", nodes)
        forget(last)
        forget(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("c"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("c"), F.col("b").alias("root")).distinct())
