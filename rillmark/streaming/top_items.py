"""The commonest items of an endless stream in bounded state.

Items are dealt by hash to slices. A slice keeps ``counters`` items with counts; whatever a micro-batch adds, if there are more
items than counters the count of the first one too many is taken from all, and items without any left go (the
merge of frequent-item summaries). Each such step takes its amount from over ``counters`` items, so what has been
taken from an item, ``off``, is at most the slice's events divided by counters + 1:
an item's true count is between ``cnt`` and ``cnt + off``, and every item above ``off`` is there.
With 1 / epsilon counters no count is off by more than epsilon times all events. Nothing is off while a slice has
fewer items than counters. Counts of a task are summed before items are dealt, so a very common item is a row for each task.

``sketch_cells`` keeps the cells of a Count-Min Sketch beside it, as many as the sketch has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from rillmark.operators import frequency

SLICES = 32


def counters_for(epsilon: float) -> int:
    return max(1, -int(-1 // epsilon))


def merged(counts: dict, more: dict, counters: int) -> tuple[dict, int]:
    """Counts of both, cut down to ``counters`` items, and what the cut has taken from each."""
    both = dict(counts)
    for item, n in more.items():
        both[item] = both.get(item, 0) + n
    if len(both) <= counters:
        return both, 0
    cut = sorted(both.values(), reverse=True)[counters]
    return {i: n - cut for i, n in both.items() if n > cut}, cut


class Counters(StatefulProcessor):
    def __init__(self, counters: int, k: int, item: DataType):
        self.counters, self.k, self.item = counters, k, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("items", ArrayType(self.item)), StructField("counts", ArrayType(LongType()))]
        fields += [StructField(c, LongType()) for c in ("off", "total", "seen")]
        self.held = handle.getValueState("counters", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts, off, total, seen = {}, 0, 0, 0
        if self.held.exists():
            items, numbers, off, total, seen = self.held.get()
            counts = dict(zip(items, numbers, strict=True))
        for part in rows:
            sums = part.groupby("item", sort=False)["n"].sum()
            counts, cut = merged(counts, dict(zip(sums.index.tolist(), sums.tolist(), strict=True)), self.counters)
            off, total = off + cut, total + int(sums.sum())
        self.held.update((list(counts), list(counts.values()), off, total, seen + 1))
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: self.k]
        out = pd.DataFrame(top, columns=["item", "cnt"])
        yield out.assign(slice=key[0], off=off, total=total, seen=seen + 1)[["slice", "item", "cnt", "off", "total", "seen"]]

    def close(self) -> None:
        pass


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a batch by item."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["slice", "item"]).aggregate([("n", "sum")]).rename_columns(["slice", "item", "n"])
        yield from sums.to_batches()


def top_items(events: DataFrame, column: str, k: int, epsilon: float = 0.001, weight: Column | None = None, slices: int = SLICES) -> DataFrame:
    """slice, item, cnt, off, total, seen of the k commonest items of every slice that a micro-batch has touched; rows of a
    slice with a higher ``seen`` take the place of its earlier ones. Null items don't count."""
    weight = F.lit(1) if weight is None else weight
    kind = events.schema[column].dataType
    rows = events.where(F.col(column).isNotNull()).select(F.pmod(F.xxhash64(column), F.lit(slices)).cast("int").alias("slice"), F.col(column).alias("item"), weight.cast("long").alias("n"))
    rows = rows.mapInArrow(summed, f"slice int, item {kind.simpleString()}, n long")
    shape = f"slice int, item {kind.simpleString()}, cnt long, off long, total long, seen long"
    return rows.groupBy("slice").transformWithStateInPandas(Counters(counters_for(epsilon), k, kind), outputStructType=shape, outputMode="update", timeMode="None")


def latest(rows: DataFrame, k: int) -> DataFrame:
    """item, cnt, off of the k commonest of what ``top_items`` has given so far, ties by item."""
    last = F.max("seen").over(Window.partitionBy("slice"))
    return rows.withColumn("_last", last).where("seen = _last").orderBy(F.desc("cnt"), "item").limit(k).select("item", "cnt", "off")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by item, null too."""
    for batch in batches:
        yield from pa.table({"item": batch.column(0)}).group_by("item").aggregate([([], "count_all")]).rename_columns(["item", "n"]).to_batches()


def sketch_cells(events: DataFrame, column: str, width: int, depth: int) -> DataFrame:
    """row, col, cnt: the cells of a Count-Min Sketch of a stream (complete or update mode). A task's items are counted
    before they are hashed."""
    items = events.select(F.col(column).alias("item")).mapInArrow(counted, f"item {events.schema[column].dataType.simpleString()}, n long")
    hit = items.select("n", frequency.cells("item", width, depth).alias("c"))
    return hit.groupBy("c.row", "c.col").agg(F.sum("n").alias("cnt"))
