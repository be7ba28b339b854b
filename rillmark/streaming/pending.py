"""A queue over micro-batches: what has arrived waits until it is its turn, so many a trigger.

Arrivals are written once, in ranges of priority and time, and never again. A trigger releases the n first of all that waits, in order of priority,
time and id, and keeps the last of them as its cut. What a later trigger may
release of an arrival is what is behind every cut since it came, so of each arrival only row groups behind its
highest cut are read; the cuts are a row for each trigger. A trigger that is repeated after a failure writes the same again.

When nothing arrives any more, all that waits is released at once: its places in the whole order, by a range sort, say
which trigger releases it. So draining is a few jobs, however many triggers it stands for.
"""

from __future__ import annotations

import uuid
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.operators import priority
from rillmark.sources.files import MOUNTED, scratch

#: A cut behind everything.
ALL = (1 << 31) - 1


class PendingQueue:
    """``n`` is what a trigger releases, at most; events have priority, ts and event_id (a whole number)."""

    def __init__(self, spark: SparkSession, n: int, path: str | None = None):
        self.spark, self.n = spark, n
        self.path = path or f"{scratch(spark)}/queue-{uuid.uuid4().hex}"
        self.cuts: dict[int, tuple[int, int, int]] = {}

    def _read(self, name: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def _known_cuts(self, before: int) -> dict[int, tuple[int, int, int]]:
        if not self.cuts:
            rows = self._read("cuts")
            self.cuts = {r.batch: (r.priority, r.us, r.event_id) for r in rows.collect()} if rows is not None else {}
        return {b: c for b, c in self.cuts.items() if b < before}

    def waiting(self, batch: int) -> DataFrame | None:
        """What waits before a trigger, its own arrivals included."""
        rows = self._read("arrived")
        if rows is None:
            return None
        cuts, behind, high = self._known_cuts(batch), [], None
        for arrived in range(batch, -1, -1):  # the highest cut since, of each arrival
            if arrived in cuts:
                high = max(high or cuts[arrived], cuts[arrived])
            behind.append((high, arrived))
        wanted = F.lit(False)
        for cut, same in groupby(behind, key=lambda x: x[0]):
            arrivals = [a for _, a in same]
            if cut is None or cut[0] < ALL:
                wanted = wanted | (F.col("arrival").between(min(arrivals), max(arrivals)) & self._after(cut))
        return rows.where(wanted)

    def _after(self, cut: tuple[int, int, int] | None) -> Column:
        if cut is None:
            return F.lit(True)
        p, us, i = cut
        time = F.timestamp_micros(F.lit(us))
        return (F.col("priority") > p) | ((F.col("priority") == p) & ((F.col("ts") > time) | ((F.col("ts") == time) & (F.col("event_id") > i))))

    def trigger(self, batch: DataFrame | None, number: int) -> int:
        """One trigger: arrivals in, the first ``n`` of all out; how many were released."""
        if batch is not None:
            laid = batch.repartitionByRange("priority", "ts").sortWithinPartitions("priority", "ts")
            laid.write.options(**MOUNTED).mode("overwrite").parquet(f"{self.path}/arrived/arrival={number}")
        waiting = self.waiting(number)
        if waiting is None:
            return 0
        order = Window.orderBy("priority", "ts", "event_id")
        first = waiting.orderBy("priority", "ts", "event_id").limit(self.n).withColumn("place", F.row_number().over(order))  # n rows
        first.drop("arrival").write.options(**MOUNTED).mode("overwrite").parquet(f"{self.path}/out/batch={number}")
        out = self.spark.read.parquet(f"{self.path}/out/batch={number}")
        last = out.orderBy(F.desc("place")).limit(1).select("priority", F.unix_micros("ts").alias("us"), "event_id", "place").collect()
        released = last[0].place if last else 0
        self._cut(number, (last[0].priority, last[0].us, last[0].event_id) if released == self.n else (ALL, 0, 0))
        return released

    def drain(self, number: int) -> int:
        """What triggers without arrivals release, from ``number`` on, until nothing waits; the number of the next one."""
        waiting = self.waiting(number)
        if waiting is None:
            return number + 1
        place, at = F.col("place") - 1, f"{self.path}/drained/first={number}"
        turns = priority.placed(waiting.drop("arrival")).withColumn("batch", (F.floor(place / self.n) + number).cast("int"))
        turns.withColumn("place", (place % self.n + 1).cast("int")).write.options(**MOUNTED).mode("overwrite").parquet(at)
        last = number + self.spark.read.parquet(at).count() // self.n  # releases less than n
        self._cut(last, (ALL, 0, 0))
        return last + 1

    def _cut(self, number: int, cut: tuple[int, int, int]) -> None:
        self.cuts[number] = cut
        row = self.spark.createDataFrame([cut], "priority int, us long, event_id long").coalesce(1)
        row.write.options(**MOUNTED).mode("overwrite").parquet(f"{self.path}/cuts/batch={number}")

    def released(self) -> DataFrame | None:
        """All that was released, with batch and place in it (from 1)."""
        one, many = self._read("out"), self._read("drained")
        if one is None or many is None:
            return one if many is None else many.drop("first")
        return one.unionByName(many.drop("first"))

    def statistics(self) -> DataFrame:
        """batch, priority, arrived, released, pending (what waits after the batch) of every batch and priority that has had an event."""
        came = self._read("arrived").groupBy(F.col("arrival").alias("batch"), "priority").agg(F.count("*").alias("arrived"))
        went = self.released().groupBy(F.col("batch").cast("long").alias("batch"), "priority").agg(F.count("*").alias("released"))
        steps = self._read("cuts").select(F.col("batch").cast("long").alias("batch")).union(went.select("batch")).distinct().crossJoin(came.unionByName(went, True).select("priority").distinct())  # four priorities
        both = steps.join(came, ["batch", "priority"], "left").join(went, ["batch", "priority"], "left").fillna(0, ["arrived", "released"])
        upto = Window.partitionBy("priority").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("pending", F.sum(F.col("arrived") - F.col("released")).over(upto))


def released_in_order(events: DataFrame, queue: PendingQueue, checkpoint: str, base: dict[str, int] = priority.BASE, default: int = priority.STANDARD):
    """A running query that puts a stream's events into a queue and releases from it at every trigger."""
    take = lambda batch, number: queue.trigger(priority.classified(batch, base, default), number)
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
