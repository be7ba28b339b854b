"""Event priorities and processing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import numbered

PAYMENT, PREMIUM, STANDARD, BACKGROUND = 0, 1, 2, 3
NAMES = ("PAYMENT", "PREMIUM", "STANDARD", "BACKGROUND")
#: The priority of each type of event; others are STANDARD.
BASE = {
    "purchase": PAYMENT,
    "subscription": PAYMENT,
    "play": PREMIUM,
    "pause": STANDARD,
    "resume": STANDARD,
    "quality_change": STANDARD,
    "search": STANDARD,
    "like": BACKGROUND,
    "dislike": BACKGROUND,
    "comment": BACKGROUND,
    "log": BACKGROUND,
}


def priority(event_type: Column, premium: Column, base: dict[str, int] = BASE, default: int = STANDARD) -> Column:
    """The type's priority; premium users are lifted to PREMIUM and nobody is lowered."""
    levels = F.create_map(*(F.lit(x) for pair in base.items() for x in pair))
    out = F.coalesce(F.try_element_at(levels, event_type), F.lit(default))
    return F.when(F.coalesce(premium, F.lit(False)) & (out > PREMIUM), PREMIUM).otherwise(out).cast("int")


def classified(events: DataFrame, base: dict[str, int] = BASE, default: int = STANDARD) -> DataFrame:
    return events.withColumn("priority", priority(F.col("event_type"), F.col("is_premium"), base, default))


ORDER = ("priority", "ts", "event_id")


def placed(events: DataFrame) -> DataFrame:
    """Adds place (from 1) in processing order: rows are sorted by range, so no task has all of a priority."""
    return numbered(events, *ORDER).withColumn("place", F.col("place") + 1)


def drained(events: DataFrame) -> DataFrame:
    """All events in processing order: priority, then arrival, then id."""
    return events.orderBy(*ORDER)


def batch(events: DataFrame, n: int) -> DataFrame:
    """The next n events; n = 1 is the one in front."""
    return events.orderBy(*ORDER).limit(n)


def pending(events: DataFrame) -> DataFrame:
    """Events waiting by priority."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("priority") + 1)
    return events.groupBy("priority").agg(F.count("*").alias("pending")).withColumn("name", name)


def average_wait_ms(events: DataFrame, processed_ts: str = "processed_ts") -> DataFrame:
    wait = (F.unix_micros(processed_ts) - F.unix_micros("ts")) / 1000.0
    return events.agg(F.avg(wait).alias("avg_wait_ms"), F.count("*").alias("processed"))
