"""Items of similar users, and what is popular where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.sources.files import stored

from . import similarity as sim

#: Items of neighbours that a task adds up, at most if users have as many as others.
PLACES = 1 << 22


def recommend(watches: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    """user_id, item, score, rank: unseen items by the summed similarity of the neighbours that
    have them (rounded to 9 digits, ties by item)."""
    seen = watches.select("user_id", "item").distinct()
    liked = neighbours.select(F.col("u").alias("user_id"), F.col("v").alias("_v"), "similarity").join(seen.toDF("_v", "item"), "_v")
    scores = liked.groupBy("user_id", "item").agg(F.round(F.sum("similarity"), 9).alias("score"))
    unseen = scores.join(seen, ["user_id", "item"], "left_anti")
    top = Window.partitionBy("user_id").orderBy(F.desc("score"), "item")
    return unseen.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def recommend_from_profiles(profiles: DataFrame, neighbours: DataFrame, most: int, k: int = 10) -> DataFrame:
    """What ``recommend`` gives of the watches in ``similarity.profiles``, with up to ``most`` neighbours of a user, ranked from 1.

    A null item is never seen and comes last. A neighbour's items go to the user as one array, and the user's own as well, if there are neighbours; there they are
    added up and ranked without being shuffled again, in as many tasks as items need, so that a task's share doesn't grow with the input.
    """
    spark = profiles.sparkSession
    lists = profiles.where("user_id is not null").select("user_id", F.array_distinct("watched.item").alias("items"))
    entries = profiles.agg(F.coalesce(F.sum(F.size("watched")), F.lit(0)).alias("n")).first().n
    tasks = max(spark.sparkContext.defaultParallelism, -(-entries * (most + 1) // PLACES))
    near = F.struct("v", "similarity", F.lit(False).alias("own"))
    self_ = F.struct(F.col("u").alias("v"), F.lit(0.0).alias("similarity"), F.lit(True).alias("own"))
    asked = neighbours.select(F.col("u").alias("user_id"), F.explode(F.when(F.col("rank") == 1, F.array(near, self_)).otherwise(F.array(near))).alias("_a")).select("user_id", "_a.*")
    given = asked.join(lists.toDF("v", "items"), "v").repartition(tasks, "user_id")
    items = F.when(F.col("own"), F.filter("items", lambda x: x.isNotNull())).otherwise(F.col("items"))
    there = given.select("user_id", "similarity", "own", F.explode(items).alias("item"))
    scores = there.groupBy("user_id", "item").agg(F.round(F.sum("similarity"), 9).alias("score"), F.max("own").alias("seen")).where("not seen").drop("seen")
    top = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc_nulls_last("item"))
    return scores.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def popular(watches: DataFrame, k: int) -> DataFrame:
    """item, score, rank of the k most watched items: at most k rows."""
    counts = watches.groupBy("item").agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "item").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item")))


def with_fallback(users: DataFrame, recommended: DataFrame, watches: DataFrame, k: int) -> DataFrame:
    """Users without a recommendation get what is popular, seen or not; broadcasts k rows."""
    recommended = stored(recommended, "recommended")  # read twice
    rest = users.select("user_id").distinct().join(recommended.select("user_id").distinct(), "user_id", "left_anti")
    offered = rest.crossJoin(F.broadcast(popular(watches, k)))
    cols = ["user_id", "item", "score", "rank"]
    return recommended.select(*cols, F.lit("similar").alias("source")).unionByName(offered.select(*cols, F.lit("popular").alias("source")))


def statistics(watches: DataFrame, k: int, bands: int) -> DataFrame:
    per = watches.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item").alias("items"))
    return per.withColumn("lsh_threshold", F.round(F.lit(sim.lsh_threshold(k, bands)), 4))
