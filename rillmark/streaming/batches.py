"""Micro-batches: tables as streams, sinks that take a batch twice without harm, ways to stop and go on."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark.sources.files import MOUNTED, forget, reachable, scratch, stored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a replayed file, and files of a part.
FILE_ROWS, MOST_FILES = 250_000, 1000


def replayed(rows: DataFrame, parts: int, *by: str, closing: DataFrame | None = None) -> DataFrame:
    """A table as a stream of ``parts`` micro-batches, dealt by a hash of the columns ``by`` (of all
    columns), so that batches are in no order of time; ``closing`` is a last one of its own."""
    rows = stored(rows, "rows")  # read for each part
    part = F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(parts))
    return _streamed([rows.where(part == i) for i in range(parts)] + [closing] * (closing is not None), rows)


def replayed_in_order(rows: DataFrame, parts: int, column: str = "ts") -> DataFrame:
    """The same by ranges of a column of times."""
    rows, us = stored(rows, "rows"), F.unix_micros(column)
    cuts = rows.agg(F.percentile_approx(us, [i / parts for i in range(1, parts)], 10_000).alias("cuts")).collect()[0].cuts or []
    ends = [None, *sorted(set(cuts)), None]
    ranges = [(F.lit(True) if a is None else us > a) & (F.lit(True) if b is None else us <= b) for a, b in zip(ends, ends[1:], strict=False)]
    return _streamed([rows.where(r) for r in ranges], rows)


def _streamed(parts: list[DataFrame], rows: DataFrame) -> DataFrame:
    """Parts written one after the other, as files are read in the order of their times: as many files for each part, and so many a
    trigger. A part with less rows than that has empty files besides."""
    spark = rows.sparkSession
    path = f"{scratch(spark)}/replay-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    count = rows.count()
    files = max(1, min(-(-count // (len(parts) * FILE_ROWS)), MOST_FILES))
    for i, part in enumerate(parts):
        laid = part.coalesce(1) if files == 1 else part.repartition(files)
        laid.write.options(**MOUNTED).mode("append").parquet(path)
        there = sum(status.getPath().getName().endswith(".parquet") for status in fs.listStatus(at))
        for _ in range((i + 1) * files - there):
            spark.createDataFrame([], rows.schema).coalesce(1).write.options(**MOUNTED).mode("append").parquet(path)
    forget(rows)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, as states of several columns need."""
    reachable(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Batches:
    """A folder with one table for each micro-batch of a stream, and the stream's checkpoint.

    A batch that is run again after a failure takes the place of its first attempt, so every row is there once,
    whenever the query was lost; a new query over the same folder goes on where the last one has ended.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        self.path = path or f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.options(**MOUNTED).mode("overwrite").parquet(f"{self.path}/out/batch={number}")

    def forget_before(self, number: int) -> None:
        """Deletes the tables of all batches before one that is written."""
        fs, out = self._folder()
        for status in fs.listStatus(out):
            named = status.getPath().getName()
            if named.startswith("batch=") and int(named[6:]) < number:
                fs.delete(status.getPath(), True)

    def _folder(self) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/out")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def start(self, stream: DataFrame, mode: str = "append", take: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
        """Starts a query that hands every micro-batch to ``take`` (default: into the folder)."""
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(take or self.write)
        with keyed_state(self.spark):
            return (writer.trigger(**trigger) if trigger else writer).start()

    def run(self, stream: DataFrame, mode: str = "append", take: Callable[[DataFrame, int], None] | None = None) -> Batches:
        """The same for all that the stream has now."""
        self.start(stream, mode, take, availableNow=True).awaitTermination()
        return self

    def rows(self, schema) -> DataFrame:
        """All rows so far, with the number of their batch."""
        none = self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        fs, out = self._folder()
        if not fs.exists(out):
            return none
        return self.spark.read.schema(none.schema).parquet(f"{self.path}/out")


def stop_drained(query: StreamingQuery) -> None:
    """Lets a query end what has arrived, then stops it; what fails on the way is still in its checkpoint."""
    if query.isActive:
        query.processAllAvailable()
    query.stop()
