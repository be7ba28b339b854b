"""The trailing window of every event of a stream.

Time is cut into slots. An event goes to its own slot and, as background, to each later one whose windows reach it. A
slot's state is a list of its own events and a ring of counts of what is before and in it, one count for each
sub-window of ``resolution``; a timer at the slot's end, by the watermark, gives all its events with their counts and
clears it. So the result is that of the batch form for input that is out of order within the watermark; later
events are dropped. With the finest resolution, a microsecond, counts are exact; a coarser one bounds the
ring by sub-windows and counts the oldest one whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType


class Slot(StatefulProcessor):
    def __init__(self, width_us: int, slot_us: int, resolution_us: int):
        self.width_us, self.slot_us, self.resolution_us = width_us, slot_us, resolution_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getListState("own", StructType([StructField("event_id", LongType()), StructField("us", LongType())]))
        self.ring = handle.getValueState("ring", StructType([StructField("at", BinaryType()), StructField("n", BinaryType())]))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.ring.exists():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.frombuffer(b, np.int64) for b in self.ring.get())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, n = self.counts()
        if not len(at):
            self.handle.registerTimer((key[0] + 1) * self.slot_us // 1000 + 1)
        for part in rows:
            cells = part["us"].to_numpy() // self.resolution_us
            at, inverse = np.unique(np.concatenate([at, cells]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n, np.ones(len(cells), np.int64)]), len(at)).astype(np.int64)
            own = part[part["us"] // self.slot_us == key[0]]
            if len(own):
                self.own.appendList(list(zip(own["event_id"].tolist(), own["us"].tolist(), strict=True)))
        self.ring.update((at.tobytes(), n.tobytes()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = list(self.own.get())
        if rows:
            ids, us = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            at, n = self.counts()
            upto = np.append(0, np.cumsum(n))
            last = np.searchsorted(at, us // self.resolution_us, "right")
            first = np.searchsorted(at, (us - self.width_us) // self.resolution_us, "left")
            yield pd.DataFrame({"event_id": ids, "in_window": upto[last] - upto[first]})
        self.own.clear()
        self.ring.clear()

    def close(self) -> None:
        pass


def trailing_counts(events: DataFrame, seconds: int, late: str = "10 minutes", slot: int | None = None, resolution: str = "1 microsecond") -> DataFrame:
    """event_id, in_window: events in the closed window [ts - seconds, ts], of every event whose slot is over.

    ``slot`` has the window's length unless it is given (in seconds, up to ``seconds``).
    """
    width, length = seconds * 1_000_000, (slot or seconds) * 1_000_000
    us = F.unix_micros("ts")
    timed = events.withWatermark("ts", late).withColumn("us", us)
    reach = F.sequence(F.floor(F.col("us") / length), F.floor((F.col("us") + width) / length))
    copies = timed.select("ts", F.col("event_id").cast("long").alias("event_id"), "us", F.explode(reach).alias("slot"))
    state = Slot(width, length, max(1, int(pd.Timedelta(resolution).total_seconds() * 1_000_000)))
    return copies.groupBy("slot").transformWithStateInPandas(state, outputStructType="event_id long, in_window long", outputMode="append", timeMode="EventTime")
