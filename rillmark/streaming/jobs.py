"""Streaming forms of the engine's operators.

Event time with a watermark bounds what is kept; counters of items and of users' addresses are
kept for as long as the watermark says. Order by priority exists within a micro-batch only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillmark.operators import priority
from rillmark.sources.events import as_activity
from rillmark.sources.files import scratch

from .batches import Batches


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True)
    return as_activity(reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"))


def window_counts(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events by window and type; windows close when the watermark has passed them."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "cnt")


def sliding_counts(events: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("cnt"))
    return counted.select(F.col("w.start").alias("window_start"), "cnt")


def item_counts(plays: DataFrame) -> DataFrame:
    return plays.where("item is not null").groupBy("item").agg(F.count("*").alias("cnt"))


def flagged_users(events: DataFrame, threshold: int, late: str = "10 minutes", keep: str = "400 days", all_counts: bool = True) -> DataFrame:
    """user_id, event_id, addresses of every event from the one on with which the user has
    ``threshold`` addresses; a user's addresses are forgotten once the watermark is ``keep``
    beyond the user's last event. Without ``all_counts`` no more than ``threshold`` are remembered."""
    kind = events.schema["user_id"].dataType.simpleString()
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = set(state.get[0]) if state.exists else set()
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        out = []
        for event_id, address in zip(rows["event_id"], rows["address"], strict=True):
            if all_counts or len(known) < threshold:
                known.add(address)
            if len(known) >= threshold:
                out.append((key[0], int(event_id), len(known)))
        state.update((sorted(known),))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "addresses"]).astype({"event_id": "int64", "addresses": "int64"})

    rows = events.withWatermark("ts", late).where("address is not null").select("user_id", "event_id", "ts", F.col("address").cast("string").alias("address")).where("address <> ''")
    return rows.groupBy("user_id").applyInPandasWithState(
        judge, f"user_id {kind}, event_id long, addresses long", "addresses array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Everything the stream has, run to its end; a micro-batch that is repeated takes the place of its first
    attempt. In complete mode only the last result is kept."""
    sink = Batches(stream.sparkSession, name)

    def replace(batch: DataFrame, number: int) -> None:
        sink.write(batch, number)
        sink.forget_before(number)

    rows = sink.run(stream, mode, replace if mode == "complete" else None).rows(stream.schema)
    return rows.drop("batch")


def by_priority(events: DataFrame, handler: Callable[[DataFrame, int], None], base: dict[str, int] = priority.BASE, default: int = priority.STANDARD) -> StreamingQuery:
    """Every micro-batch, in processing order, to a handler."""

    def deliver(batch: DataFrame, number: int) -> None:
        handler(priority.drained(priority.classified(batch, base, default)), number)

    return events.writeStream.option("checkpointLocation", f"{scratch(events.sparkSession)}/{uuid.uuid4().hex}").foreachBatch(deliver).start()


def on_flagged(events: DataFrame, threshold: int, handler: Callable[[DataFrame, int], None]) -> StreamingQuery:
    flagged = flagged_users(events, threshold)
    return flagged.writeStream.outputMode("append").option("checkpointLocation", f"{scratch(events.sparkSession)}/{uuid.uuid4().hex}").foreachBatch(handler).start()


def on_trending(plays: DataFrame, k: int, handler: Callable[[list[tuple], int], None]) -> StreamingQuery:
    """Calls a handler with the k commonest items whenever a micro-batch has changed them."""
    shown: list[list[tuple]] = [[]]

    def compare(batch: DataFrame, number: int) -> None:
        top = [(r["item"], r["cnt"]) for r in batch.orderBy(F.desc("cnt"), "item").limit(k).collect()]
        if top != shown[0]:
            shown[0] = top
            handler(top, number)

    at = f"{scratch(plays.sparkSession)}/{uuid.uuid4().hex}"
    return item_counts(plays).writeStream.outputMode("complete").option("checkpointLocation", at).foreachBatch(compare).start()


def metrics(query: StreamingQuery) -> dict:
    """What the engine says of a running query."""
    last = query.lastProgress or {}
    keys = ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")
    return {"active": query.isActive} | {k: last.get(k) for k in keys} | {"latency_ms": (last.get("durationMs") or {}).get("triggerExecution")}


def dashboard(stats: dict, types: list[tuple[str, int]], top: list[tuple[str, int]]) -> str:
    """A text frame from one row of statistics and two short lists."""
    hits, misses = stats.get("hits", 0), stats.get("misses", 0)
    rate = f"{hits / (hits + misses) * 100:.1f}%" if hits + misses else "0.0%"
    lines = [f"events {stats.get('events', 0):>12,}", f"alerts {stats.get('alerts', 0):>12,}", f"cache  {hits:>12,}  ({rate})", "types"]
    lines += [f"  {name:<18} {n:>8,}" for name, n in types]
    lines += ["trending", *(f"  {i}. {name:<14} {n:>8,}" for i, (name, n) in enumerate(top, 1))]
    return "\n".join(lines)
