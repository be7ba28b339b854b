"""What a least-recently-used cache would hit, hold and evict.

The order of accesses is cut into blocks of ``span`` positions. What the cache holds when a block
begins are the ``capacity`` keys used last before it. Blocks are summed up (at most ``capacity`` keys
each), and the sums of 1, 2, 4, ... blocks are merged in as many rounds as the number of blocks has
binary digits, so no task sees more than two sums a block; then every block is played by itself.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.sources.files import stored


def contents(accesses: DataFrame, capacity: int) -> DataFrame:
    """key, pos, rank from the most to the least recently used, after all accesses."""
    last = accesses.groupBy("key").agg(F.max("pos").alias("pos")).orderBy(F.desc("pos")).limit(max(1, capacity))
    return last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pos"))))


def contains(accesses: DataFrame, probes: DataFrame, capacity: int) -> DataFrame:
    """key and held (in the cache after all accesses) of every distinct probe; nothing is moved."""
    held = contents(accesses, capacity).select("key", F.lit(True).alias("held"))
    return probes.select("key").distinct().join(held, "key", "left").select("key", F.coalesce("held", F.lit(False)).alias("held"))


def in_blocks(accesses: DataFrame, span: int) -> DataFrame:
    return accesses.select("pos", "key", F.floor(F.col("pos") / span).cast("long").alias("block"))


def latest(uses: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` keys used last of every block, of rows (block, key, pos)."""
    recent = Window.partitionBy("block").orderBy(F.desc("pos"))
    return uses.groupBy("block", "key").agg(F.max("pos").alias("pos")).withColumn("r", F.row_number().over(recent)).where(F.col("r") <= capacity).drop("r")


def held_before(rows: DataFrame, capacity: int) -> DataFrame:
    """block, key, pos of what the cache holds when each block begins."""
    ends = rows.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).collect()[0]
    if ends.lo is None:
        return rows.select("block", "key", "pos")
    blocks = rows.sparkSession.range(ends.lo, ends.hi + 1).toDF("block")
    upto = stored(latest(rows, capacity), "cache-blocks")
    reach = 1
    while reach <= ends.hi - ends.lo:
        later = upto.select((F.col("block") + reach).alias("block"), "key", "pos").join(blocks, "block", "left_semi")
        upto = stored(latest(upto.unionByName(later), capacity), "cache-blocks")
        reach *= 2
    return upto.select((F.col("block") + 1).alias("block"), "key", "pos")


def play(accesses: DataFrame, capacity: int, span: int = 100_000) -> DataFrame:
    """pos, key, hit, evicted (the key that a miss pushes out) of every access (pos: long, key).

    A miss puts the key in; a capacity under 1 is 1.
    """
    capacity = max(1, capacity)
    rows = in_blocks(accesses, span)
    kind = rows.schema["key"].dataType.simpleString()

    def simulate(own: pd.DataFrame, held_rows: pd.DataFrame) -> pd.DataFrame:
        held = OrderedDict((k, True) for k in held_rows.sort_values("pos")["key"])
        hits, evicted = [], []
        own = own.sort_values("pos")
        for key in own["key"]:
            hits.append(key in held)
            if key in held:
                held.move_to_end(key)
                evicted.append(None)
            else:
                held[key] = True
                evicted.append(held.popitem(last=False)[0] if len(held) > capacity else None)
        return pd.DataFrame({"pos": own["pos"], "key": own["key"], "hit": hits, "evicted": pd.Series(evicted, index=own.index, dtype=object)})

    return rows.groupBy("block").cogroup(held_before(rows, capacity).groupBy("block")).applyInPandas(simulate, f"pos long, key {kind}, hit boolean, evicted {kind}")


def operate(operations: DataFrame, capacity: int, by: str = "cache") -> DataFrame:
    """Columns ``by`` and pos, found (a get hits, contains is true, a put updates) and evicted of every
    operation (``by``, pos, key, op: get, put or contains), each cache played by itself.

    Only a put brings a key in, and it is no hit; a get and a put move the key to the front, contains
    moves nothing. What one get does depends on all operations before it, so a cache is one log in
    one task; many caches are played side by side.
    """
    capacity = max(1, capacity)
    kind = operations.schema[by].dataType.simpleString()
    key_kind = operations.schema["key"].dataType.simpleString()

    def simulate(own: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        own = own.sort_values("pos")
        found, evicted = [], []
        for key, op in zip(own["key"], own["op"], strict=True):
            found.append(key in held)
            out = None
            if op != "contains" and key in held:
                held.move_to_end(key)
            elif op == "put":
                if len(held) >= capacity:
                    out = held.popitem(last=False)[0]
                held[key] = True
            evicted.append(out)
        return pd.DataFrame({by: own[by], "pos": own["pos"], "found": found, "evicted": pd.Series(evicted, index=own.index, dtype=object)})

    return operations.select(by, "pos", "key", "op").groupBy(by).applyInPandas(simulate, f"`{by}` {kind}, pos long, found boolean, evicted {key_kind}")


def reuse_distance(accesses: DataFrame, most: int, span: int = 100_000) -> DataFrame:
    """Adds distance, the number of other keys used since the key's last access; null at first, and
    where it is ``most`` or more. A cache of a capacity up to ``most`` hits where distance < capacity,
    so one pass is right for all of them.
    """
    rows = in_blocks(accesses, span)
    kind = rows.schema["key"].dataType.simpleString()

    def measure(own: pd.DataFrame, held_rows: pd.DataFrame) -> pd.DataFrame:
        own, before = own.sort_values("pos"), held_rows.sort_values("pos")["key"].tolist()
        keys = before + own["key"].tolist()
        tree = [0] * (len(keys) + 1)  # sums of places that are their key's last one so far

        def add(at: int, n: int) -> None:
            at += 1
            while at <= len(keys):
                tree[at] += n
                at += at & -at

        def upto(at: int) -> int:
            total = 0
            while at > 0:
                total += tree[at]
                at -= at & -at
            return total

        last: dict = {}
        out = []
        for at, key in enumerate(keys):
            was = last.get(key)
            if at >= len(before):
                n = None if was is None else upto(at) - upto(was + 1)
                out.append(n if n is not None and n < most else None)
            if was is not None:
                add(was, -1)
            add(at, 1)
            last[key] = at
        return pd.DataFrame({"pos": own["pos"], "key": own["key"], "distance": pd.array(out, "Int64")})

    return rows.groupBy("block").cogroup(held_before(rows, max(1, most)).groupBy("block")).applyInPandas(measure, f"pos long, key {kind}, distance long")


def statistics(played: DataFrame) -> DataFrame:
    hits = F.count(F.when(F.col("hit"), 1))
    return played.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.coalesce(hits.cast("double") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hit_rate"))


def full_statistics(played: DataFrame, capacity: int) -> DataFrame:
    """The same with capacity, size and evictions."""
    out = F.count("evicted")
    return played.agg(
        F.lit(capacity).alias("capacity"), (F.count(F.when(~F.col("hit"), 1)) - out).alias("size"), F.count(F.when(F.col("hit"), 1)).alias("hits"),
        F.count(F.when(~F.col("hit"), 1)).alias("misses"), out.alias("evictions"),
    )


def served(log: DataFrame, capacity: int, span: int = 100_000) -> DataFrame:
    """pos, key, from_cache of the requests in a log (pos, key, request: false for a view of the key's
    user, which makes what is cached for the user outdated).

    A view leaves an empty entry, so both touch the cache; a request is answered from it if the entry
    is held and the user's last entry in the log was a request.
    """
    own = Window.partitionBy("key").orderBy("pos")
    asked = log.withColumn("fresh", F.coalesce(F.lag("request").over(own), F.lit(False))).where("request").select("pos", "fresh")
    return play(log, capacity, span).join(asked, "pos").select("pos", "key", (F.col("hit") & F.col("fresh")).alias("from_cache"))
