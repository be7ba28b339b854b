"""Accounts that show up from many addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 3


def running_flag(events: DataFrame, threshold: int = THRESHOLD, slot: str = "day") -> DataFrame:
    """Adds addresses (distinct ones of the user up to this event) and flagged.

    Events without an address are not judged. An address's first use is the least event of the user and the address, found before
    rows meet. A user's first uses are summed by slot of time, what came before a slot over the user's slots,
    and what comes within it over the events of the user and the slot; so no task has all events of a user.
    """
    seen = events.where("address is not null and cast(address as string) <> ''").withColumn("_slot", F.date_trunc(slot, "ts"))
    firsts = seen.groupBy(F.col("user_id").alias("_u"), F.col("address").alias("_a")).agg(F.min(F.struct("ts", "event_id")).alias("_f"))
    marked = seen.join(firsts, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("address") == F.col("_a")))
    marked = marked.withColumn("_new", (F.struct("ts", "event_id") == F.col("_f")).cast("long")).drop("_u", "_a", "_f")
    per_slot = marked.groupBy(F.col("user_id").alias("_u"), F.col("_slot").alias("_s")).agg(F.sum("_new").alias("_n"))
    earlier = Window.partitionBy("_u").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slot.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))).drop("_n")
    upto = Window.partitionBy("user_id", "_slot").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.withColumn("_own", F.sum("_new").over(upto))
    out = within.join(before, F.col("user_id").eqNullSafe(F.col("_u")) & F.col("_slot").eqNullSafe(F.col("_s")))
    out = out.withColumn("addresses", F.col("_base") + F.col("_own")).drop("_new", "_own", "_base", "_slot", "_u", "_s")
    return out.withColumn("flagged", F.col("addresses") >= threshold)


def suspects(events: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Users with that many distinct addresses or more; pairs are made distinct before users meet."""
    pairs = events.where("address is not null and cast(address as string) <> ''").select("user_id", "address").distinct()
    return pairs.groupBy("user_id").agg(F.count("*").alias("addresses")).where(F.col("addresses") >= threshold)
