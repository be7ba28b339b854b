"""Recommendations that are served while watches come in, from a cache that watches make outdated.

Watches go through ``signatures`` into a stored index, and leave for each user the number of the last micro-batch in which the user watched
anything. A request is answered from the cache if the user's list there is newer than that. All others are
answered together: their keys meet the index in place, only their candidates' signatures are fetched, and whoever
has no similar user gets what is popular. What they get is cached. All of it is tables in the shared folder, one part for
each batch, so that a batch that is repeated takes the place of its first attempt, and a new service over the folder goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.operators import recommend, similarity
from rillmark.operators.lsh_index import BUCKET_ROWS, LshIndex
from rillmark.sources.files import stored

from .batches import Batches
from .signatures import changed_keys


class RecommendationService:
    """``k`` hashes in ``bands``; lists of ``n`` items from ``neighbours`` similar users, or of the ``n`` most popular. ``rows`` as of ``LshIndex``."""

    def __init__(self, spark: SparkSession, user_type: str = "long", item_type: str = "long", k: int = 128, bands: int = 32, neighbours: int = 20, n: int = 10, path: str | None = None, rows: int = BUCKET_ROWS):
        self.spark, self.k, self.bands, self.neighbours, self.n = spark, k, bands, neighbours, n
        self.changes = Batches(spark, "service", path)
        self.index = LshIndex(spark, user_type, rows=rows, path=f"{self.changes.path}/index")
        self.touched, self.cache = (Batches(spark, x, f"{self.changes.path}/{x}") for x in ("touched", "cache"))
        self.user = f"user_id {user_type}"
        self.cached = f"{self.user}, items array<{item_type}>, source string, from_cache boolean"

    def ingest(self, watches: DataFrame) -> None:
        """Takes all that a stream of watches (user_id, item) has now."""

        def take(batch: DataFrame, number: int) -> None:
            batch = stored(batch, "changes")
            self.touched.write(batch.where("band < 0").select("user_id"), number)
            self.index.apply(batch.where("band >= 0"), number)

        self.changes.run(changed_keys(watches, self.k, self.bands, mark=True), "update", take)

    def fresh(self) -> DataFrame:
        """user_id, items, source of the lists that no watch has made outdated."""
        last = self.touched.rows(self.user).groupBy("user_id").agg(F.max("batch").alias("watched"))
        rows = self.cache.rows(self.cached).where("not from_cache")
        newest = rows.groupBy("user_id").agg(F.max(F.struct("batch", "items", "source")).alias("c"))
        return newest.join(last, "user_id", "left").where("watched is null or c.batch > watched").select("user_id", "c.items", "c.source")

    def signatures(self, users: DataFrame) -> DataFrame:
        """user_id, sig of some users, from the keys of their bands."""
        rows = self.index.current().join(users, "user_id", "left_semi").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("band", "key"))).alias("b"))
        return rows.select("user_id", F.split(F.array_join("b.key", "-"), "-").cast("array<long>").alias("sig"))

    def similar(self, users: DataFrame) -> DataFrame:
        """u, v, similarity, rank: the nearest of some users among all that are indexed."""
        keys = self.index.current().join(users, "user_id", "left_semi")
        pairs = stored(self.index.candidates(keys), "pairs")
        involved = pairs.select(F.explode(F.array("u", "v")).alias("user_id")).distinct()
        scored = similarity.scored(pairs, stored(self.signatures(involved), "signatures"), self.k)
        top = Window.partitionBy("u").orderBy(F.desc("similarity"), "v")
        return scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= self.neighbours)

    def serve(self, requests: DataFrame, watches: DataFrame, number: int) -> DataFrame:
        """user_id, items, source (similar or popular), from_cache of every user that asks (user_id).

        ``watches`` are those ingested so far. Requests are numbered like the micro-batches of watches, and are after the one of the
        same number.
        """
        asked = requests.select("user_id").distinct()
        held = stored(asked.join(self.fresh(), "user_id"), "held")
        missing = stored(asked.join(held, "user_id", "left_anti"), "missing")
        found = recommend.recommend(watches, self.similar(missing), self.n).select("user_id", "item", "score", "rank")
        rows = recommend.with_fallback(missing, found, watches, self.n)
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"])
        made = rows.groupBy("user_id").agg(in_order.alias("items"), F.first("source").alias("source")).withColumn("from_cache", F.lit(False))
        self.cache.write(made.unionByName(held.withColumn("from_cache", F.lit(True))), number + 1)
        return self.cache.rows(self.cached).where(F.col("batch") == number + 1).drop("batch")

    def statistics(self, watches: DataFrame) -> DataFrame:
        """One row of structs: recommender (users, catalog, threshold), top_k (total, tracked) and cache (requests, hits, misses, hit_rate)."""
        of = watches.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item").alias("catalog"), F.count("item").alias("total"))
        hits = F.count(F.when(F.col("from_cache"), 1))
        served = self.cache.rows(self.cached).agg(F.count("*").alias("requests"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.coalesce(hits / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hit_rate"))
        row = of.crossJoin(served)  # one row each
        threshold = F.round(F.lit(similarity.lsh_threshold(self.k, self.bands)), 3).alias("threshold")
        return row.select(F.struct("users", "catalog", threshold).alias("recommender"), F.struct("total", F.least("catalog", F.lit(self.n)).alias("tracked")).alias("top_k"), F.struct("requests", "hits", "misses", "hit_rate").alias("cache"))
