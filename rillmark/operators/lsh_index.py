"""A stored index of band keys that takes changes and is asked without being shuffled.

The index is a table bucketed by band and key. Changes are appended, each with a version: a key that is there or one that
is gone. What holds is the last version of a user's key, which each bucket finds by itself; so neither that nor a
query moves the index, only what is asked moves to its buckets. ``compact`` writes what holds as a new generation and
takes it in place of the old ones, whose files it deletes. An append that is repeated changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.sources.files import MOUNTED, scratch

#: Rows of a bucket that an index is laid out for.
BUCKET_ROWS = 2_000_000


class LshIndex:
    """``rows`` is how many keys are expected: it only decides the number of buckets."""

    def __init__(self, spark: SparkSession, user_type: str = "long", rows: int = BUCKET_ROWS, path: str | None = None):
        self.spark, self.user_type = spark, user_type
        self.buckets = max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
        self.path = path or f"{scratch(spark)}/lsh-{uuid.uuid4().hex}"
        self.generation = 0
        self._register()

    def _register(self) -> None:
        """The catalog's entry of a generation; a session that opens the folder anew makes its own."""
        self.name = f"lsh_{uuid.uuid4().hex[:12]}"
        self.spark.sql(
            f"create table {self.name} (band int, key string, user_id {self.user_type}, version long, gone boolean) using parquet "
            f"clustered by (band, key) into {self.buckets} buckets location '{self.path}/{self.generation}'"
        )

    def apply(self, changes: DataFrame, version: int) -> None:
        """Appends changes (user_id, band, key, gone); later versions win."""
        rows = changes.select(F.col("band").cast("int").alias("band"), "key", F.col("user_id").cast(self.user_type).alias("user_id"), F.lit(version).cast("long").alias("version"), "gone")
        laid = rows.repartition(self.buckets, "band", "key")  # a file for each bucket
        laid.write.options(**MOUNTED).mode("append").insertInto(self.name)

    def add(self, keys: DataFrame, version: int) -> None:
        """Appends keys (user_id, band, key) that are there from now on."""
        self.apply(keys.withColumn("gone", F.lit(False)), version)

    def remove(self, users: DataFrame, version: int) -> None:
        """Takes all keys of some users (user_id) away; users that aren't there change nothing."""
        known = self.current().join(users.select("user_id").distinct(), "user_id", "left_semi")
        self.apply(known.withColumn("gone", F.lit(True)), version)

    def current(self) -> DataFrame:
        """band, key, user_id of what holds."""
        last = self.spark.table(self.name).groupBy("band", "key", "user_id").agg(F.max(F.struct("version", (~F.col("gone")).alias("there"))).alias("last"))
        return last.where("last.there").select("band", "key", "user_id")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """u, v: users of the index that share a band with one that asks (user_id, band, key), who needn't be in it."""
        asks = asked.select(F.col("user_id").alias("u"), F.col("band").cast("int").alias("band"), "key")
        return asks.join(self.current().withColumnRenamed("user_id", "v"), ["band", "key"]).where("not (u <=> v)").select("u", "v").distinct()

    def size(self) -> int:
        """Users that are there."""
        return self.current().select("user_id").distinct().count()

    def compact(self) -> None:
        held, old, last = self.current(), self.name, f"{self.path}/{self.generation}"
        self.generation += 1
        self._register()
        rows = held.select("band", "key", "user_id", F.lit(0).cast("long").alias("version"), F.lit(False).alias("gone"))
        rows.write.options(**MOUNTED).mode("append").insertInto(self.name)  # still by bucket
        self.spark.sql(f"drop table {old}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(last)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
