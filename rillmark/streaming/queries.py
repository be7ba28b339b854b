"""Streams over the given tables, run to their end; the results equal the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import frequency
from rillmark.operators.lsh_index import LshIndex
from rillmark.plans import queries as q
from rillmark.sources import events as src

from . import batches, bot_filter, jobs, pending, signatures, top_items, trailing
from .service import RecommendationService

EV = "ev as (select event_id, ts, user_id, event_type, cast(json_extract(props, '$.k') as bigint) k from events)"
#: Micro-batches that a table is replayed in, events that a trigger releases, and pairs of a user and an address that are expected.
PARTS, RELEASED, PAIRS = 3, 4000, 200_000


def stream_item_counts(spark, d):
    plays = jobs.event_stream(spark, d).where("event_type = 'view'")
    return jobs.run_to_table(jobs.item_counts(plays), "complete", "items")


def stream_window_counts(spark, d):
    out = jobs.run_to_table(jobs.window_counts(jobs.event_stream(spark, d), "1 hour"), "complete", "windows")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_flagged_users(spark, d):
    return jobs.run_to_table(jobs.flagged_users(jobs.event_stream(spark, d), 50), "append", "flags")


def expected_keys(spark, d) -> int:
    """Rows of an index of all customers: each key, and as many again that take the place of others."""
    return 2 * q.BANDS * src.read_table(spark, d, "customer").count()


def stream_lsh_index(spark, d):
    """The banded index after watches have come in micro-batches, the customers that owe money were removed, and it was compacted."""
    index = LshIndex(spark, rows=expected_keys(spark, d))
    changes = signatures.changed_keys(batches.replayed(q.history(spark, d), PARTS), q.K, q.BANDS)
    batches.Batches(spark, "signatures").run(changes, "update", index.apply)
    gone = src.read_table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    index.remove(gone, 1 << 40)
    index.compact()
    return index.current()


def stream_topk(spark, d):
    """The ten commonest items of views that have come in micro-batches, by counters of bounded number."""
    tops = top_items.top_items(batches.replayed(src.plays(spark, d), PARTS), "item", 10, 0.001)
    out = batches.Batches(spark, "top").run(tops, "update").rows(tops.schema)
    return top_items.latest(out, 10)


def stream_cms_cells(spark, d):
    """The cells of the sketch, kept over micro-batches."""
    cells = top_items.sketch_cells(batches.replayed(src.activity(spark, d), PARTS), "item", q.CMS_W, q.CMS_D)
    return jobs.run_to_table(cells, "complete", "cells")


def stream_cms_estimate(spark, d):
    """What that sketch says of every item."""
    return frequency.estimate(src.activity(spark, d), "item", stream_cms_cells(spark, d), q.CMS_W, q.CMS_D)


def stream_flagged_filter(spark, d):
    """Flagged users by Bloom filters over micro-batches in order of time."""
    flags = bot_filter.flagged_users(batches.replayed_in_order(src.activity(spark, d), PARTS), 50, PAIRS, 1e-9)
    return batches.Batches(spark, "filter").run(flags).rows(flags.schema).drop("batch")


def stream_trailing_count(spark, d):
    """The trailing hour of every event, which come in no order; a last event after all others closes their windows."""
    events = src.activity(spark, d)
    last = events.agg(F.max("ts").alias("ts")).select(*((F.col("ts") + F.expr("interval 1000 days") if c == "ts" else F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in events.columns))
    counts = trailing.trailing_counts(batches.replayed(events, PARTS, closing=last), 3600, "900 days")
    return batches.Batches(spark, "trailing").run(counts).rows(counts.schema).drop("batch")


def stream_priority_batches(spark, d):
    """All events, in the batches that a queue releases them in."""
    queue = pending.PendingQueue(spark, RELEASED)
    batches.Batches(spark, "queue").run(batches.replayed(q.events(spark, d), 1), take=queue.trigger)
    queue.drain(1)
    return queue.released().select("event_id", F.col("priority").cast("int").alias("priority"), F.col("batch").cast("int").alias("batch"), F.col("place").cast("int").alias("place"))


def served_recommendations(spark, d):
    """Lists for all customers after half of them have asked before; watches came in micro-batches before both."""
    watches = q.history(spark, d)
    service = RecommendationService(spark, k=q.K, bands=q.BANDS, neighbours=q.TOP, rows=expected_keys(spark, d))
    service.ingest(batches.replayed(watches, PARTS))
    users = src.read_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    service.serve(users.where("user_id % 2 = 0"), watches, PARTS)
    return service.serve(users, watches, PARTS + 1).withColumn("items", F.array_join("items", ","))


QUERIES = {f.__name__: f for f in (
    stream_item_counts, stream_window_counts, stream_flagged_users, stream_lsh_index, stream_topk, stream_cms_cells, stream_cms_estimate, stream_flagged_filter,
    stream_trailing_count, stream_priority_batches, served_recommendations,
)}
FLAGS = f"""with {EV}, f as (select *, case when row_number() over (partition by user_id, k order by ts, event_id) = 1 then 1 else 0 end f from ev),
      g as (select user_id, event_id, cast(sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) addresses from f) select * from g where addresses >= 50"""
SQL = {
    "stream_item_counts": f"with {EV} select k as item, count(*) cnt from ev where event_type = 'view' group by k",
    "stream_window_counts": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) cnt from events group by 1, 2",
    "stream_flagged_users": FLAGS,
    "stream_lsh_index": f"with {q.SIG_SQL}, {q.BAND_SQL} select cast(band as integer) band, key, user_id from b where user_id not in (select c_custkey from customer where c_acctbal < 0)",
    "stream_topk": f"with {EV} select k as item, count(*) cnt, 0::bigint as off from ev where event_type = 'view' group by k order by cnt desc, k limit 10",
    "stream_cms_cells": q.SQL["cms_cells"],
    "stream_cms_estimate": q.SQL["cms_estimate"],
    "stream_flagged_filter": FLAGS,
    "stream_trailing_count": q.SQL["trailing_window_count"],
    "served_recommendations": f"""with {q.SIG_SQL}, {q.BAND_SQL}, {q.EST_SQL}, {q.TWO_SQL.format(e="e", n=q.TOP)}, {q.REC_SQL},
      own as (select user_id, string_agg(cast(item as varchar), ',' order by rank) as items from rec group by 1),
      pop as (select string_agg(cast(item as varchar), ',' order by score desc, item) as items from (select item, count(*) score from w group by item order by 2 desc, 1 limit 10))
      select c_custkey user_id, coalesce(own.items, pop.items) as items, case when own.items is null then 'popular' else 'similar' end as source, c_custkey % 2 = 0 from_cache
      from customer cross join pop left join own on own.user_id = c_custkey""",
    "stream_priority_batches": f"""with {q.EV}, o as (select event_id, priority, row_number() over (order by priority, ts, event_id) - 1 r from ev)
      select event_id, cast(priority as integer) priority, cast(r // {RELEASED} as integer) batch, cast(r % {RELEASED} + 1 as integer) place from o""",
}
