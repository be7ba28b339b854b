"""Readers for activity events, titles and watch histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of an event file with a header row.
CSV_SCHEMA = "timestamp timestamp, user_id string, event_type string, video_id string, ip string, is_premium boolean, session_id string, quality string"

#: Schema of an event on the wire.
WIRE_SCHEMA = "timestamp timestamp, user_id string, event_type string, video_id string, ip string, is_premium boolean, session_id string, payload map<string,string>"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the engine's terms: item and address are ``props.k``."""
    return as_activity(read_table(spark, sf_dir, "events"))


def as_activity(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", k.alias("item"), k.alias("address"),
        (F.col("user_id") % 5 == 0).alias("is_premium"), "value",
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).where("event_type = 'view'")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog titles, one row for each time a title is listed."""
    return read_table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts they ordered, as users and items."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("user_id", "item")
