"""Users with many addresses in a stream, by Bloom filters in place of lists of addresses.

Users are dealt by hash to slices. A slice's state is a filter of the (user, address) pairs that it has seen, of a size that is set
by the number of pairs expected and the error wanted, and a count for each user. A pair that the filter
doesn't know is a new address. A pair that it takes for known by mistake isn't counted: a user's addresses are
never too many, and each is missed with the error's probability. Where more pairs come than were expected, a filter that is half full
is left as it is and another of twice its size and half its error takes what is new; so the error is at most
twice the one wanted, whatever comes, and the state grows with the pairs of a generation.

Filters are forgotten by generations of ``keep`` of event time: a pair is remembered for that long after it was last seen, and
for twice as long at most; a user without an event for twice as long is forgotten. So neither grows for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rillmark.operators import bloom

SLICES = 32
#: Pairs that are looked up at once.
CHUNK = 1 << 15


class PairFilter(StatefulProcessor):
    def __init__(self, threshold: int, bits: int, hashes: int, keep_us: int):
        self.threshold, self.bits, self.hashes, self.keep_us = threshold, -(-bits // 8) * 8, hashes, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(c, BinaryType()) for c in ("now", "old", "users", "counts", "lasts")] + [StructField("began", LongType())]
        self.held = handle.getValueState("filter", StructType(fields))

    def positions(self, h1: np.ndarray, h2: np.ndarray, layer: int) -> np.ndarray:
        """The bits of each pair in a layer, a row for each pair, from two hashes. Steps are mixed before they are cut
        down to the layer: pairs that share a start and a step there would else share all bits."""
        steps = np.arange(self.hashes + layer, dtype=np.uint64)[None, :]
        x = h1.view(np.uint64)[:, None] + steps * (h2.view(np.uint64)[:, None] | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.bits << layer)).astype(np.int64)

    def layers(self, body: bytes) -> list[np.ndarray]:
        """The filters of a generation: each has twice the bits of the one before, and one hash more."""
        bits, out, at = np.unpackbits(np.frombuffer(body, np.uint8)).view(bool), [], 0
        while at < len(bits):
            out.append(bits[at : at + (self.bits << len(out))])
            at += len(out[-1])
        return out

    def knows(self, layers: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        for at in range(0, len(h1), CHUNK):
            part = slice(at, at + CHUNK)
            for i, layer in enumerate(layers):
                out[part] |= layer[self.positions(h1[part], h2[part], i)].all(axis=1)
        return out

    def add(self, layers: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> None:
        """Puts pairs in; no layer is filled beyond its half."""
        at = 0
        while at < len(h1):
            i, last = len(layers) - 1, layers[-1]
            room = (len(last) // 2 - int(np.count_nonzero(last))) // (self.hashes + i)
            if room < 1 + len(last) // 64 // (self.hashes + i) and last.any():
                layers.append(np.zeros(self.bits << len(layers), bool))
                continue
            part = slice(at, at + min(max(room, 1), CHUNK))
            last[self.positions(h1[part], h2[part], i).ravel()] = True
            at = part.stop

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        empty = lambda: [np.zeros(self.bits, bool)]
        now, old, known, began = empty(), empty(), pd.DataFrame({"n": [], "last": []}, dtype="int64"), None
        if self.held.exists():
            now_, old_, users, counts, lasts, began = self.held.get()
            now, old = self.layers(now_), self.layers(old_)
            known = pd.DataFrame({"n": np.frombuffer(counts, np.int64), "last": np.frombuffer(lasts, np.int64)}, index=np.frombuffer(users, np.int64))
        events = pd.concat(rows).sort_values(["us", "event_id"], kind="stable").reset_index(drop=True)
        newest = int(events["us"].max())
        began = int(events["us"].min()) if began is None else began
        if newest >= began + self.keep_us:
            now, old, began = empty(), now if newest < began + 2 * self.keep_us else empty(), newest
        known = known[known["last"] >= newest - 2 * self.keep_us]
        first = ~events.duplicated(["user", "h1", "h2"]).to_numpy()
        h1, h2 = events["h1"].to_numpy()[first], events["h2"].to_numpy()[first]
        held = self.knows(now, h1, h2)
        fresh = np.zeros(len(events), bool)
        fresh[np.flatnonzero(first)] = ~(held | self.knows(old, h1, h2))
        self.add(now, h1[~held], h2[~held])
        before = known["n"].reindex(events["user"]).fillna(0).to_numpy().astype(np.int64)
        addresses = before + pd.Series(fresh.astype(np.int64)).groupby(events["user"]).cumsum().to_numpy()
        seen = pd.DataFrame({"n": addresses, "last": events["us"].to_numpy()}).groupby(events["user"].to_numpy()).max()
        both = pd.concat([known, seen]).groupby(level=0).max()
        packed = [np.packbits(np.concatenate(x)).tobytes() for x in (now, old)] + [np.ascontiguousarray(x, np.int64).tobytes() for x in (both.index, both["n"], both["last"])]
        self.held.update((*packed, began))
        over = addresses >= self.threshold
        yield pd.DataFrame({"user_id": events["user_id"][over], "event_id": events["event_id"][over], "addresses": addresses[over]})

    def close(self) -> None:
        pass


def flagged_users(events: DataFrame, threshold: int, pairs: int, fp_rate: float = 0.001, keep: str = "400 days", slices: int = SLICES) -> DataFrame:
    """user_id, event_id, addresses of every event from the one on with which its user has ``threshold`` addresses.

    ``pairs`` is how many different pairs of a user and an address are expected within ``keep``; more are judged as well. Events
    without an address are not judged; events are taken in order of time within a micro-batch.
    """
    kind = events.schema["user_id"].dataType.simpleString()
    each = max(64, -(-pairs * 3 // (2 * slices)))  # slices aren't filled alike
    m = bloom.bits_for(each, fp_rate)
    address = F.col("address").cast("string")
    pair = [F.xxhash64(F.lit(seed), "user_id", address).alias(f"h{seed}") for seed in (1, 2)]
    rows = events.where(F.col("address").isNotNull() & (address != "")).select(
        F.pmod(F.xxhash64("user_id"), F.lit(slices)).cast("int").alias("slice"), "user_id", F.xxhash64("user_id").alias("user"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("us"), *pair
    )
    state = PairFilter(threshold, m, bloom.hashes_for(m, each), int(pd.Timedelta(keep).total_seconds() * 1_000_000))
    return rows.groupBy("slice").transformWithStateInPandas(state, outputStructType=f"user_id {kind}, event_id long, addresses long", outputMode="append", timeMode="None")
