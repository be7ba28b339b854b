"""Everything that happens to an event, as branches of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.sources.files import stored

from . import bots, cache, prefix, priority, similarity


def dispatch(events: DataFrame, threshold: int, play: str = "play", payments: tuple[str, ...] = ("purchase", "subscription")) -> DataFrame:
    """event_id, user_id, event_type, priority, flagged, action of classified events.

    Every event is judged by its addresses; plays with an item go to the cache and the
    recommender, payments are marked. One shuffle, by user, for all of it.
    """
    judged = bots.running_flag(events, threshold)
    action = F.when((F.col("event_type") == play) & F.col("item").isNotNull(), "watch").when(F.col("event_type").isin(*payments), "payment").otherwise("none")
    return judged.select("event_id", "user_id", "event_type", "priority", "flagged", action.alias("action"))


def processed(events: DataFrame, catalog: DataFrame, threshold: int, capacity: int, play: str = "play", search: str = "search", payments: tuple[str, ...] = ("purchase", "subscription"), span: int = 100_000) -> DataFrame:
    """event_id, place, user_id, event_type, priority, flagged, action, cache and suggestions of
    every classified event, as it is processed in order of priority.

    Plays with an item go through the content cache (HIT or MISS) in that order; searches (column
    query) are offered the best terms of the catalog and of the searches processed before; payments
    are marked. The branches meet by event.
    """
    order = stored(priority.placed(events), "placed")
    flags = bots.running_flag(order, threshold).select("event_id", "flagged")
    plays = order.where((F.col("event_type") == play) & F.col("item").isNotNull())
    cached = cache.play(plays.select(F.col("place").alias("pos"), F.col("item").alias("key")), capacity, span)
    cached = cached.select(F.col("pos").alias("place"), F.when(F.col("hit"), "HIT").otherwise("MISS").alias("cache"))
    asked = order.where((F.col("event_type") == search) & F.col("query").isNotNull()).select(F.col("place").alias("search_id"), "query")
    offered = prefix.suggested_before(asked, catalog).groupBy(F.col("search_id").alias("place"))
    offered = offered.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "|").alias("suggestions"))
    action = F.when((F.col("event_type") == play) & F.col("item").isNotNull(), "watch").when(F.col("event_type").isin(*payments), "payment").when(F.col("event_type") == search, "search").otherwise("none")
    both = order.join(flags, "event_id", "left").join(cached, "place", "left").join(offered, "place", "left")
    return both.select("event_id", "place", "user_id", "event_type", "priority", F.coalesce("flagged", F.lit(False)).alias("flagged"), action.alias("action"), "cache", "suggestions")


def full_statistics(done: DataFrame, plays: DataFrame, capacity: int, top: int, k: int, bands: int) -> DataFrame:
    """One row of everything: events processed by priority, alerts and bots, the content cache, the
    tracker of trending items and the recommender."""
    misses = F.count(F.when(F.col("cache") == "MISS", 1))
    per = [F.count(F.when(F.col("priority") == p, 1)).alias(f"priority_{p}") for p in range(4)]
    row = done.agg(
        F.count("*").alias("processed"), F.lit(0).cast("long").alias("pending"), *per, F.count(F.when(F.col("flagged"), 1)).alias("alerts"),
        F.count(F.when(F.col("cache") == "HIT", 1)).alias("cache_hits"), misses.alias("cache_misses"), F.count("suggestions").alias("searches_answered"),
    )
    bot_users = done.where("flagged").agg(F.countDistinct("user_id").alias("bots"))
    seen = plays.where("item is not null").agg(F.count("*").alias("trending_total"), F.countDistinct("item").alias("catalog"), F.countDistinct("user_id").alias("indexed_users"))
    both = row.crossJoin(bot_users).crossJoin(seen)  # one row each
    size = F.least(F.col("catalog"), F.lit(capacity))
    rate = F.coalesce(F.col("cache_hits").cast("double") / F.nullif(F.col("cache_hits") + F.col("cache_misses"), F.lit(0)), F.lit(0.0))
    return both.withColumn("cache_size", size.cast("long")).withColumn("cache_evictions", F.col("cache_misses") - size).withColumn("cache_hit_rate", rate).withColumn("trending_tracked", F.least(F.col("catalog"), F.lit(top)).cast("long")).withColumn("lsh_threshold", F.round(F.lit(similarity.lsh_threshold(k, bands)), 3))


def statistics(dispatched: DataFrame) -> DataFrame:
    """One row: events, alerts (events) and bots (users), payments, watches, by priority.

    Alerts are summed by user first, so that distinct users need no second pass over events.
    """
    flags = [F.count(F.when(F.col("priority") == p, 1)).alias(f"priority_{p}") for p in range(4)]
    n = [F.count("*").alias("events"), F.count(F.when(F.col("flagged"), 1)).alias("alerts"), F.count(F.when(F.col("action") == "payment", 1)).alias("payments"), F.count(F.when(F.col("action") == "watch", 1)).alias("watches")]
    per_user = dispatched.groupBy("user_id").agg(*n, *flags)
    names = ["events", "alerts", "payments", "watches", *(f"priority_{p}" for p in range(4))]
    return per_user.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names), F.count(F.when(F.col("alerts") > 0, 1)).alias("bots"))
