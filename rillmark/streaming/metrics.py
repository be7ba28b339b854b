"""What streams have received, let in and dropped, as a table.

``admitted`` stands at the head of a query: it counts what comes, drops what is late by the watermark and what has been
there already, row by row, so that both are told apart exactly. ``MetricsTable`` listens to the session's queries and
writes a line for each micro-batch, in a file named by query and batch: a batch that is repeated is
there once, and the driver holds nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from rillmark.sources.files import scratch

SCHEMA = (
    "query string, batch long, at string, watermark string, received long, late long, repeated long, input_rows long, "
    "rows_per_second double, latency_ms long, state_rows long, state_bytes long"
)


def admitted(events: DataFrame, late: str = "10 minutes", key: str = "event_id", time: str = "ts") -> DataFrame:
    """The events of a stream that are neither late nor repeated within the watermark."""
    counted = events.observe("received", F.count(F.lit(1)).alias("n"))
    return counted.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class MetricsTable(StreamingQueryListener):
    """Add it to ``spark.streams`` before a query starts, and take it away with ``close``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{scratch(spark)}/metrics-{uuid.uuid4().hex}"
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = json.loads(event.progress.json)
        states = told.get("stateOperators") or []
        gate = [s for s in states if "dedup" in s["operatorName"].lower()]
        first = gate[:1] or states[:1]  # what is late is dropped by the first that keeps a state
        row = {
            "query": str(told["id"]), "batch": told["batchId"], "at": told["timestamp"], "watermark": (told.get("eventTime") or {}).get("watermark"),
            "received": (told.get("observedMetrics") or {}).get("received", {}).get("n", told["numInputRows"]),
            "late": sum(s["numRowsDroppedByWatermark"] for s in first), "repeated": sum((s.get("customMetrics") or {}).get("numDroppedDuplicateRows", 0) for s in gate),
            "input_rows": told["numInputRows"], "rows_per_second": told.get("processedRowsPerSecond"), "latency_ms": (told.get("durationMs") or {}).get("triggerExecution"),
            "state_rows": sum(s["numRowsTotal"] for s in states), "state_bytes": sum(s["memoryUsedBytes"] for s in states),
        }
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{row['query']}-{row['batch']}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(json.dumps(row).encode())
        out.close()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self) -> DataFrame:
        """A row for each micro-batch so far; what Spark has still to tell is waited for."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return self.spark.read.schema(SCHEMA).json(self.path)

    def totals(self) -> DataFrame:
        """query, received, late, repeated, passed, batches and mean latency of every query."""
        sums = [F.sum(c).alias(c) for c in ("received", "late", "repeated")]
        per = self.rows().groupBy("query").agg(*sums, F.count("*").alias("batches"), F.avg("latency_ms").alias("latency_ms"))
        return per.withColumn("passed", F.col("received") - F.col("late") - F.col("repeated"))

    def close(self) -> None:
        self.spark.streams.removeListener(self)
