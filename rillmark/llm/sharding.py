"""Sharding by balanced label propagation, under the law of rows.

Linked documents hang on common hubs (for equal texts: the text), so that a group of n documents
has n links and not n**2. They start dealt out evenly, without regard to their links, and move in
rounds. In each round

* every hub counts its documents by shard and takes as its targets the shards where most of them
  are and, with what room is left there (or swaps may make, a quarter of the quota), the whole group
  fits; a group that fits into no shard takes as many as it needs;
* documents outside the targets of their hubs ask for one of them;
* requests are granted where others go the other way, directly or around several shards, or where
  the quota leaves room, so no shard ever holds more than its quota; of the askers between two
  shards exactly so many move, drawn by a hash.

A shard's quota is its share of all rows. Documents without links have no wish: they fill up what
the propagated ones leave, which makes the counts differ by one at most and moves no linked one.

Sums by hub are combined before the shuffle; joins on hubs are skew joins that Spark may split, and
askers are ranked within 1,024 bins by hash of each pair of shards. The driver reads the matrix of
requests (shards**2 numbers) and the row count of each partition, nothing by document.

Defined results: a null text has no bytes, CRC 0, and is linked with nothing; empty texts are
equal; rows that repeat are documents of their own; very long texts count by their size only; an
empty table gives no rows; with fewer rows than shards some shards stay empty. Columns other than
those named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, table, written

SHARDS = 24
ROUNDS = 8
#: The part of a shard that a hub hopes to get by swaps where there is less room.
SWAPS = 4
BINS, DRAWS = 10, 20


def quotas(total: int, shards: int) -> np.ndarray:
    """Rows of every shard, at most one apart."""
    return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)


def way(rest: np.ndarray, begin: int, ends: np.ndarray) -> list[int]:
    """The shortest way over what is left to grant to a shard of ``ends``; empty if there is none."""
    before, todo = {}, [begin]
    for at in todo:  # sees the shards that it adds
        for to in np.flatnonzero(rest[at]).tolist():
            if ends[to]:
                path = [to, at]
                while path[-1] != begin:
                    path.append(before[path[-1]])
                return path[::-1]
            if to != begin and to not in before:
                before[to] = at
                todo.append(to)
    return []


def granted(asked: np.ndarray, rows: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """Moves from shard to shard that leave no shard over its quota: swaps, ways that end where there
    is room, and round trips."""
    rest = asked - np.minimum(asked, asked.T)
    room = np.maximum(quota - rows, 0)
    for trips in (False, True):
        for begin in range(len(asked)):
            while path := way(rest, begin, np.arange(len(asked)) == begin if trips else (room > 0) & (np.arange(len(asked)) != begin)):
                steps = list(zip(path[:-1], path[1:], strict=True))
                most = min([rest[x] for x in steps] + [room[path[-1]]] * (not trips))
                for x in steps:
                    rest[x] -= most
                if not trips:
                    room[path[-1]] -= most
                    room[begin] += most
    return asked - rest


def hub_targets(linked: DataFrame, room: np.ndarray, quota: np.ndarray) -> DataFrame:
    """hub, here (its documents by shard) and targets (shard, free: how many more it takes there)."""
    shards = len(room)
    here = F.array(*(F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)))
    counted = linked.groupBy("hub").agg(here.alias("here"), F.count("*").alias("n"))
    entry = lambda s: F.struct(F.least(F.col("n"), F.col("here")[s] + int(room[s]), F.lit(int(quota[s]))).alias("fits"), F.col("here")[s].alias("own"), F.xxhash64("hub", F.lit(s)).alias("tie"), F.lit(s).alias("shard"))
    ordered = F.sort_array(F.array(*(entry(s) for s in range(shards))), asc=False)
    none = F.expr("cast(array() as array<struct<shard:int,free:long>>)")

    def take(acc, x):
        free = F.greatest(F.least(x["fits"], acc["left"]) - x["own"], F.lit(0).cast("long"))
        more = F.struct((acc["left"] - x["fits"]).alias("left"), F.array_append(acc["out"], F.struct(x["shard"].alias("shard"), free.alias("free"))).alias("out"))
        return F.when(acc["left"] > 0, more).otherwise(acc)

    targets = F.aggregate(ordered, F.struct(F.col("n").alias("left"), none.alias("out")), take, lambda acc: acc["out"])
    return counted.select("hub", "here", targets.alias("targets"))


def wishes(linked: DataFrame, room: np.ndarray, quota: np.ndarray, turn: int) -> DataFrame:
    """node, shard, to: the shard that most of a node's hubs' nodes are in or go to."""
    both = linked.join(hub_targets(linked, room, quota), "hub")
    free = F.aggregate("targets", F.lit(0).cast("long"), lambda acc, t: acc + t["free"])
    drawn = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(1)), F.greatest(F.col("free"), F.lit(1)))
    start = F.struct(F.col("drawn").alias("left"), F.lit(None).cast("int").alias("to"))
    pick = lambda acc, t: F.struct((acc["left"] - t["free"]).alias("left"), F.coalesce(acc["to"], F.when(acc["left"] < t["free"], t["shard"])).alias("to"))
    both = both.withColumn("free", free).withColumn("drawn", drawn).withColumn("picked", F.aggregate("targets", start, pick, lambda acc: acc["to"]))
    stays = F.exists("targets", lambda t: t["shard"] == F.col("shard"))
    both = both.withColumn("to", F.when(stays | (F.col("free") == 0), F.col("shard")).otherwise(F.col("picked")))
    votes = both.select("node", "shard", F.struct("to", F.get("here", "to").alias("n")).alias("v"))
    gathered = votes.groupBy("node").agg(F.first("shard").alias("shard"), F.collect_list("v").alias("v"))
    sums = F.transform(F.array_distinct(F.transform("v", lambda v: v["to"])), lambda t: F.struct(F.aggregate(F.filter("v", lambda v: v["to"] == t), F.lit(0).cast("long"), lambda acc, v: acc + v["n"]).alias("n"), t.alias("to")))
    return gathered.select("node", "shard", F.array_max(sums)["to"].alias("to"))


def moved(asks: DataFrame, moves: np.ndarray, turn: int) -> DataFrame:
    """node, to of exactly so many askers between two shards as ``moves`` says."""
    shards = len(moves)
    draw = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(2)), F.lit(1 << DRAWS))
    drawn = asks.withColumn("draw", draw).withColumn("bin", F.shiftright("draw", DRAWS - BINS))
    pair = Window.partitionBy("shard", "to").orderBy("bin")
    bins = drawn.groupBy("shard", "to", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("before", F.sum("n").over(pair) - F.col("n"))
    most = F.get(F.array(*(F.lit(int(x)) for x in moves.ravel())), F.col("shard") * shards + F.col("to"))
    bins = bins.withColumn("most", most).where("before < most").select("shard", "to", "bin", "before", "most")
    own = Window.partitionBy("shard", "to", "bin").orderBy("draw", "node")
    ranks = drawn.join(bins, ["shard", "to", "bin"]).withColumn("r", F.row_number().over(own))
    return ranks.where("before + r <= most").select("node", "to")


def propagate(links: DataFrame, quota: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """node, shard of every node in ``links`` (node: long, hub: long). ``quota``: nodes that each
    shard may hold, together as many as there are nodes or more."""
    shards = len(quota)
    total = links.count()
    nodes = ranked(links.select("node").distinct().withColumn("h", F.xxhash64("node")), total, "h", "node")
    state = written(nodes.select("node", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")), "shards", total)
    for turn in range(rounds):
        rows = np.zeros(shards, np.int64)
        for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect():
            rows[r.shard] = r.n
        room = np.maximum(quota - rows, -(-quota // SWAPS))
        asks = written(wishes(links.join(state, "node"), room, quota, turn).where("shard <> to"), "asks", total)
        asked = np.zeros((shards, shards), np.int64)
        for r in asks.groupBy("shard", "to").agg(F.count("*").alias("n")).collect():
            asked[r.shard, r.to] = r.n
        moves = granted(asked, rows, quota)
        if not moves.any():
            break
        last = state
        state = state.join(moved(asks, moves, turn), "node", "left")
        state = written(state.select("node", F.coalesce("to", "shard").alias("shard")), "shards", total)
        forget(last)
        forget(asks)
    return state


def strays(links: DataFrame, state: DataFrame) -> int:
    """How many links lead out of the shard that most of their hub's nodes are in."""
    votes = links.join(state, "node").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    per = votes.groupBy("hub").agg((F.sum("n") - F.max("n")).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]


def ranked(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """Adds rank (from 0) in the given order, which must tell all of no more than ``rows`` rows apart."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = laid.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    numbered = written(numbered, "ranked", rows)
    offset, rows = 0, []
    for r in sorted(numbered.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        rows.append((r["_p"], offset))
        offset += r.n
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _o long")
    return numbered.join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_o") + F.col("_i")).drop("_p", "_o", "_i")


def text_links(base: DataFrame, rows: int) -> DataFrame:
    """node, hub of the rows whose text (by its hash ``hub``) stands in several rows."""
    links = base.where("hub is not null").select("node", "hub")
    shared = links.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub")
    return written(links.join(shared, "hub"), "links", rows)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """id_col, size, text_crc32, shard, slot, and wish (the propagated shard; null without links) of
    every row."""
    text = F.col(text_col)
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = (F.octet_length(data) + 8).cast("long")
    hub = F.when(text.isNotNull(), F.xxhash64(data))
    base = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(data).alias("crc"), hub.alias("hub"), F.monotonically_increasing_id().alias("node"))
    base = written(base, "sizes")
    total = base.count()
    quota = quotas(total, shards)
    placed = propagate(text_links(base, total), quota, rounds).withColumnRenamed("shard", "wish")
    ordered = ranked(base.join(placed, "node", "left").withColumn("place", F.coalesce("wish", F.lit(shards))), total, "place", "hub", "node")
    rows = np.zeros(shards, np.int64)
    for r in placed.groupBy("wish").agg(F.count("*").alias("n")).collect():
        rows[r.wish] = r.n
    begins = np.cumsum(rows) - rows
    fills = np.cumsum(quota - rows)
    numbers = lambda values: F.array(*(F.lit(int(x)).cast("long") for x in values))
    rest = F.col("rank") - int(rows.sum())
    filled = F.size(F.filter(numbers(fills), lambda end: end <= rest))
    shard = F.coalesce("wish", filled).cast("int")
    slot = F.when(F.col("wish").isNotNull(), F.col("rank") - F.get(numbers(begins), "wish")).otherwise(F.get(numbers(quota - fills), "shard") + rest)
    return ordered.withColumn("shard", shard).withColumn("slot", slot).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot", "wish")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
