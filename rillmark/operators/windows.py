"""Trailing and tumbling windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.sources.files import stored


def trailing_count(events: DataFrame, seconds: int, by: str | None = None) -> DataFrame:
    """Adds in_window: events in the closed window [ts - seconds, ts], of the same ``by`` or of all."""
    if by is None:
        return trailing_total(events, seconds, seconds)
    frame = Window.partitionBy(by).orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(frame))


def trailing_total(events: DataFrame, seconds: int, slot: int) -> DataFrame:
    """The same over all events without one task seeing them all.

    Events are counted by second first. The seconds that lie wholly in a window are summed over seconds: time is cut into slots of ``slot``
    seconds, and each second goes to its own slot and, as background, to each later one whose windows can reach it.
    What a window has of its first and of its last second is counted among the events of these two.
    """
    micros, second = F.unix_micros("ts"), 1_000_000
    timed = events.withColumn("_us", micros).withColumn("_sec", F.floor(micros / second))
    cells = timed.groupBy("_sec").agg(F.count("*").alias("_n"))
    own = F.floor(F.col("_sec") / slot)
    copies = cells.withColumn("_own", own).withColumn("_slot", F.explode(F.sequence(own, F.floor((F.col("_sec") + seconds) / slot))))
    between = Window.partitionBy("_slot").orderBy("_sec").rangeBetween(1 - seconds, -1)
    whole = copies.withColumn("_whole", F.coalesce(F.sum("_n").over(between), F.lit(0).cast("long"))).where("_slot = _own").select("_sec", "_whole")
    now = timed.withColumn("_back", F.lit(0))
    back = timed.select("_us", F.lit(1).alias("_back")).withColumn("_us", F.col("_us") + seconds * second).withColumn("_sec", F.floor(F.col("_us") / second))
    meet = now.unionByName(back, allowMissingColumns=True)
    upto, after = Window.partitionBy("_sec").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("_sec").orderBy("_us").rangeBetween(0, Window.unboundedFollowing)
    edges = F.sum(1 - F.col("_back")).over(upto) + F.sum("_back").over(after)
    counted = meet.withColumn("_edges", edges).where("_back = 0").join(whole, "_sec")
    return counted.withColumn("in_window", F.col("_whole") + F.col("_edges")).drop("_us", "_sec", "_whole", "_edges", "_back")


def contents(events: DataFrame, now, seconds: int) -> DataFrame:
    return events.where((F.col("ts") >= now - F.expr(f"interval {seconds} seconds")) & (F.col("ts") <= now))


def top_types(events: DataFrame, width: str, k: int = 5) -> DataFrame:
    """window_start, event_type, cnt, rank of the k commonest types of every window."""
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("cnt"))
    top = Window.partitionBy("w").orderBy(F.desc("cnt"), "event_type")
    return counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(F.col("w.start").alias("window_start"), "event_type", "cnt", "rank")


def hot_item(events: DataFrame, width: str) -> DataFrame:
    """The item of most events in every window, ties by item, and the window's total."""
    counts = events.where("item is not null").groupBy(F.window("ts", width).alias("w"), "item").agg(F.count("*").alias("cnt"))
    top = Window.partitionBy("w").orderBy(F.desc("cnt"), "item")
    return counts.withColumn("_r", F.row_number().over(top)).where("_r = 1").select(F.col("w.start").alias("window_start"), "item", "cnt")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place (from 0) in the given order, which must tell all rows apart: rows are sorted by
    range, and the driver adds up the row counts of the partitions."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    laid = stored(laid.withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    before, offsets = 0, []
    for r in sorted(laid.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["_p"], before))
        before += r.n
    starts = rows.sparkSession.createDataFrame(offsets, "_p int, _o long")  # a row for each partition
    return laid.join(F.broadcast(starts), "_p").withColumn("place", F.col("_o") + F.col("_i")).drop("_p", "_o", "_i")


def rolling_mean(rows: DataFrame, column: str, *order: str, n: int = 1000, span: int = 100_000) -> DataFrame:
    """Adds rolling, the mean of the last n rows in the given order.

    Rows are cut into blocks of ``span`` places; each is averaged with the n - 1 rows before it.
    """
    placed = numbered(rows, *order).withColumn("_own", F.floor(F.col("place") / span))
    copies = placed.withColumn("_block", F.explode(F.sequence(F.col("_own"), F.floor((F.col("place") + n - 1) / span))))
    frame = Window.partitionBy("_block").orderBy("place").rowsBetween(1 - n, 0)
    return copies.withColumn("rolling", F.avg(column).over(frame)).where("_block = _own").drop("place", "_own", "_block")
