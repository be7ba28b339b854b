"""File sinks and sources."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: For tables in a folder that is mounted on every machine: no checksum file beside each file.
MOUNTED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def csv_of(df: DataFrame, schema: str) -> DataFrame:
    """What a CSV file of ``df`` reads as; the file is in the folder that executors share."""
    path = f"{scratch(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    write_csv(df, path)
    return df.sparkSession.read.schema(schema).option("header", True).csv(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what follows doesn't repeat it."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**MOUNTED).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes a table of ``stored`` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def reachable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless they have it."""
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in [*known.split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))


def scratch(spark) -> str:
    """``spark.checkpoint.dir``, or a temporary folder of a local session where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="rillmark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")
