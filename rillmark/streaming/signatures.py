"""MinHash signatures that grow with a stream of watches, and what changes in a banded index by that.

A user's signature is the state: k minima, whatever the user has watched. Users are dealt by hash to slices, whose signatures are kept
and lowered together in arrays: a call for each slice, not for each user. A micro-batch lowers some minima; of the bands
that change the old key is given back as gone and the new one as there. Users without a change give
nothing. After any number of micro-batches the keys that are there are those of ``similarity.band_keys`` over all watches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from rillmark.operators import similarity

#: Hashes that are combined with the family at once.
CHUNK = 4096
#: Slices of users, and users that are held before they are put together or given back at once.
SLICES, USERS = 128, 20_000


class Minima(StatefulProcessor):
    def __init__(self, k: int, bands: int, seed: int = 42, mark: bool = False):
        similarity.lsh_threshold(k, bands)
        self.mark = mark
        self.k, self.bands, self.rows = k, bands, k // bands
        self.a, self.b = (np.array(x, np.int64) for x in zip(*similarity.family(k, seed), strict=True))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("minima", StructType([StructField("minima", ArrayType(LongType()))]))

    def lowered(self, best: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        for at in range(0, len(hashes), CHUNK):
            part = hashes[at : at + CHUNK, None]
            best = np.minimum(best, ((part * self.a + self.b) % similarity.PRIME).min(axis=0))
        return best

    def keys(self, minima: np.ndarray) -> list[str]:
        return ["-".join(map(str, minima[b * self.rows : (b + 1) * self.rows])) for b in range(self.bands)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.held.exists()
        before = np.array(self.held.get()[0], np.int64) if known else np.full(self.k, similarity.PRIME)
        after = before
        for part in rows:
            after = self.lowered(after, part["h"].unique())
        if self.mark:
            yield pd.DataFrame({"user_id": [key[0]], "band": [-1], "key": [None], "gone": [False]}).astype({"band": "int32"})
        if known and (after == before).all():
            return
        self.held.update((after.tolist(),))
        old = self.keys(before) if known else [None] * self.bands
        out = []
        for band, (was, now) in enumerate(zip(old, self.keys(after), strict=True)):
            if was != now:
                out += [(key[0], band, was, True)] * (was is not None) + [(key[0], band, now, False)]
        yield pd.DataFrame(out, columns=["user_id", "band", "key", "gone"]).astype({"band": "int32"})

    def close(self) -> None:
        pass


class Slice(Minima):
    """The signatures of a slice's users: user_id, was (null: none) and now of each user that changes; with ``mark`` of every one that has rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("slice", StructType([StructField("users", BinaryType()), StructField("minima", BinaryType())]))

    def known(self) -> tuple[pd.Index, np.ndarray]:
        if not self.held.exists():
            return pd.Index([]), np.empty((0, self.k), np.int32)
        users, minima = self.held.get()
        return pd.Index(pa.ipc.open_stream(users).read_all().column(0).to_pandas()), np.frombuffer(minima, np.int32).reshape(-1, self.k)

    def least(self, part: pd.DataFrame) -> tuple[pd.Series, np.ndarray]:
        """Users of some rows, each once, and their minima over these rows."""
        number, first, h = *pd.factorize(part["user_id"], use_na_sentinel=False), part["h"].to_numpy()
        order = np.argsort(number, kind="stable")
        number, h = number[order], h[order]
        out = np.full((len(first), self.k), similarity.PRIME, np.int32)
        for at in range(0, len(h), CHUNK):
            n, hashes = number[at : at + CHUNK], h[at : at + CHUNK, None]
            edge = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
            mine = np.minimum.reduceat((hashes * self.a + self.b) % similarity.PRIME, edge, axis=0)
            out[n[edge]] = np.minimum(out[n[edge]], mine)
        return pd.Series(first), out

    def together(self, parts: list) -> list:
        users, minima = pd.concat([u for u, _ in parts], ignore_index=True), np.concatenate([m for _, m in parts])
        number, first = pd.factorize(users, use_na_sentinel=False)
        order = np.argsort(number, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(number[order]) > 0))
        return [(pd.Series(first), np.minimum.reduceat(minima[order], edge, axis=0))]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = []
        for part in rows:
            parts.append(self.least(part))
            if sum(len(u) for u, _ in parts[1:]) > USERS + len(parts[0][0]):
                parts = self.together(parts)
        users, after = self.together(parts)[0]
        every, minima = self.known()
        nobody = key[0] < 0  # the slice of the null user
        at = np.full(1, len(every) - 1) if nobody else every.get_indexer(users)
        old = at >= 0
        before = minima[at[old]]
        after[old] = np.minimum(after[old], before)
        same = np.zeros(len(users), bool)
        same[old] = (after[old] == before).all(axis=1)
        minima = minima.copy()
        minima[at[old]] = after[old]
        all_users = pa.array([0] if nobody else pd.Series([*every, *users[~old]]) if len(every) else users)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("u", all_users.type)])) as out:
            out.write_table(pa.table({"u": all_users}))
        self.held.update((sink.getvalue().to_pybytes(), np.concatenate([minima, after[~old]]).tobytes()))
        was = np.empty(len(users), object)
        was[old] = pd.Series(list(before), dtype=object).to_numpy()
        given = np.flatnonzero(~same | self.mark)
        for begin in range(0, len(given), USERS):
            some = given[begin : begin + USERS]
            yield pd.DataFrame({"user_id": [None] if nobody else users.iloc[some].to_numpy(), "was": was[some], "now": list(after[some])})


def changed_keys(watches: DataFrame, k: int, bands: int, seed: int = 42, mark: bool = False) -> DataFrame:
    """user_id, band, key, gone of a stream of watches (user_id, item); watches without an item count for nothing.
    With ``mark`` every user of a micro-batch has a row of band -1, whether a key changes or not."""
    kind = watches.schema["user_id"].dataType.simpleString()
    slice_ = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(SLICES))).cast("int")
    hashed = watches.where("item is not null").select(slice_.alias("slice"), "user_id", similarity.item_hash(watches["item"]).alias("h"))
    users = hashed.groupBy("slice").transformWithStateInPandas(
        Slice(k, bands, seed, mark), outputStructType=f"user_id {kind}, was array<int>, now array<int>", outputMode="update", timeMode="None"
    )
    rows = k // bands
    key = lambda sig, b: F.when(F.col(sig).isNotNull(), F.concat_ws("-", *(F.col(sig)[b * rows + r] for r in range(rows))))
    each = [F.struct(F.lit(b).alias("band"), key("was", b).alias("was"), key("now", b).alias("now")) for b in range(bands)]
    if mark:
        each.append(F.struct(F.lit(-1).alias("band"), F.lit(None).cast("string").alias("was"), F.lit("").alias("now")))
    differ = users.select("user_id", F.explode(F.array(*each)).alias("x")).where("not (x.was <=> x.now)")
    ways = F.array(F.struct(F.col("x.was").alias("key"), F.lit(True).alias("gone")), F.struct(F.col("x.now").alias("key"), F.lit(False).alias("gone")))
    both = differ.select("user_id", F.col("x.band").alias("band"), F.explode(ways).alias("y")).where("y.key is not null")
    return both.select("user_id", "band", F.when(F.col("band") >= 0, F.col("y.key")).alias("key"), "y.gone")
