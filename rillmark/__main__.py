"""Commands: ``python -m rillmark run|generate|demo``."""

from __future__ import annotations

import argparse
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators import bots, cache, frequency, prefix, priority, system
from rillmark.session import local_session
from rillmark.sources import files, generator
from rillmark.streaming import batches, bot_filter, frames, jobs, top_items

#: Titles of the demo.
TITLES = ("salt harbour", "salt and cinder", "the paper lighthouse", "the orchard at noon", "inkwell", "night ferry", "copper rain", "a map of echoes", "nine lanterns", "inland sea")
#: Pairs of a user and an address that a run's filters are sized for.
PAIRS = 1_000_000

#: Seconds that queries may take to start.
START = 120


def told(events: DataFrame) -> DataFrame:
    """Generated events in the engine's terms."""
    return events.select(
        F.col("id").alias("event_id"), F.col("timestamp").alias("ts"), "user_id", "event_type", F.col("video_id").alias("item"),
        F.col("ip").alias("address"), "is_premium", F.element_at("payload", "query").alias("query"),
    )


def run(spark: SparkSession, rate: int = 1000, seconds: float = 30, burst: bool = True, refresh: float = 1.0, show: Callable[[str], None] | None = print, threshold: int = 3) -> dict:
    """Processes a generated stream for some seconds; returns the totals.

    Rate 0 is what the machine can take. With a burst, three seconds in the middle have five times
    the rate (runs of ten seconds and more). Three queries run side by side: events by type, which are the dashboard's
    frames, flagged users and the commonest items. Every ``refresh`` seconds the last frame goes to ``show``.
    The time begins when all of them have ended a first micro-batch.
    What they give is in the shared folder; the driver holds a frame and the top items.
    """
    several = 5.0 if burst and seconds >= 10 else 1.0
    stream = told(generator.event_stream(spark, rate or 100_000, burst=several, burst_at=seconds / 2))
    alerts, tops, at = batches.Batches(spark, "alerts"), batches.Batches(spark, "tops"), f"{files.scratch(spark)}/run-{uuid.uuid4().hex}"
    kinds = frames.sections(stream.groupBy("event_type").agg(F.count("*").alias("n")), "events", "event_type", "n")
    flags = bot_filter.flagged_users(stream, threshold, PAIRS)
    items = top_items.top_items(stream.where("event_type = 'play'"), "item", 10)
    queries = [frames.shown(kinds, f"{at}/frames", f"{at}/checkpoint", top=50), alerts.start(flags), tops.start(items, "update")]
    try:
        ready = time.monotonic() + START
        while time.monotonic() < ready and not all(q.recentProgress or not q.isActive for q in queries):
            time.sleep(0.2)
        began = time.monotonic()
        while time.monotonic() - began < seconds and all(q.isActive for q in queries):
            time.sleep(min(refresh, seconds))
            if show:
                show(frames.last_frame(spark, f"{at}/frames") or "")
        elapsed = time.monotonic() - began
    finally:
        for q in queries:
            q.stop()
    types = json.loads(frames.last_frame(spark, f"{at}/frames", "json") or "{}").get("events", {})
    found = alerts.rows(flags.schema).agg(F.count("*").alias("alerts"), F.countDistinct("user_id").alias("bots")).collect()[0]
    top = [(r["item"], r.cnt) for r in top_items.latest(tops.rows(items.schema), 10).collect()]
    return {"events": sum(types.values()), "alerts": found.alerts, "bots": found.bots, "seconds": elapsed, "rate": sum(types.values()) / elapsed, "types": types, "top": top}


def generate(spark: SparkSession, events: int, output: str) -> None:
    files.write_csv(generator.stored(spark, events), output)


def demo(spark: SparkSession, show: Callable[[str], None] = print, events: int = 500) -> dict:
    """All parts over a few generated events, with one bot and one payment."""
    base = told(generator.events(spark, events, seed=3, users=100, items=50))
    bot = spark.range(10).select((F.col("id") + events).alias("event_id"), F.lit("bot_user").alias("user_id"), F.concat(F.lit("10.0.0."), "id").alias("address"))
    last = F.timestamp_micros(F.lit(1_735_700_000_000_000) + F.col("event_id"))
    bot = bot.select("event_id", last.alias("ts"), "user_id", F.lit("play").alias("event_type"), F.lit("video_0001").alias("item"), "address", F.lit(False).alias("is_premium"), F.lit(None).cast("string").alias("query"))
    rows = priority.classified(base.unionByName(bot))
    titles = prefix.vocabulary(spark.createDataFrame([(t,) for t in TITLES], "term string"))
    done = system.processed(rows, titles, threshold=4, capacity=20).cache()
    out = {
        "first": [r.event_type for r in done.orderBy("place").limit(1).collect()],
        "stats": system.full_statistics(done, rows.where("event_type = 'play'"), 20, 100, 128, 32).collect()[0].asDict(),
        "suspects": [r.user_id for r in bots.suspects(rows, 4).collect()],
        "completed": {p: [r.term for r in prefix.complete(titles, p, 3).collect()] for p in ("salt", "the", "in")},
        "top": [tuple(r) for r in frequency.top_k(rows.where("event_type = 'play'"), "item", 5).collect()],
        "cached": [r.key for r in cache.contents(rows.where("event_type = 'play'").select(F.col("event_id").alias("pos"), F.col("item").alias("key")), 5).collect()],
    }
    for name, value in out.items():
        show(f"{name}: {value}")
    return out


def main(words: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rillmark")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run", help="process a generated stream")
    one.add_argument("--rate", type=int, default=1000, help="events a second (0: as many as possible)")
    one.add_argument("--time", type=float, default=30, help="seconds")
    one.add_argument("--refresh", type=float, default=1.0, help="seconds between frames")
    one.add_argument("--no-burst", action="store_true")
    one.add_argument("--no-dash", action="store_true")
    two = commands.add_parser("generate", help="write a data set as CSV")
    two.add_argument("--events", type=int, default=1_000_000)
    two.add_argument("--output", default="data/events")
    commands.add_parser("demo", help="all parts over a few events")
    args = parser.parse_args(words)
    spark = SparkSession.getActiveSession() or local_session("rillmark")
    if args.command == "run":
        done = run(spark, args.rate, args.time, not args.no_burst, args.refresh, None if args.no_dash else print)
        print(jobs.dashboard(done, sorted(done["types"].items(), key=lambda x: -x[1]), done["top"]))
    elif args.command == "generate":
        generate(spark, args.events, args.output)
    else:
        demo(spark)


if __name__ == "__main__":
    main()
