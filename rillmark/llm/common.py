"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tables in a folder that is mounted on every machine: no checksum file beside each file, which
#: would be one more file, and one more process that sets its permissions, for each task.
MOUNTED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Rows of a file, and files for each core at least.
FILE_ROWS, BUSY = 100_000, 4
#: Bytes of texts that become Python objects at once.
SLICE_BYTES = 4 << 20
_scopes: list[list[DataFrame]] = []
_caches: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one.

    A local session without that setting (tests, the bench) gets a temporary folder as its
    checkpoint directory; on a cluster that is an error, as its machines share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="rillmark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: lineage ends there.

    Where it is known that there are no more than ``rows``, there are as many files as they need, or
    as keep all cores busy, and not as many as there are shuffle partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(spread(spark, rows))
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**MOUNTED).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def spread(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as many as they need, or as keep all cores busy."""
    return max(BUSY * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def forget(df: DataFrame | None) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within are deleted at the end, but for those given to the function that this
    hands over."""
    _scopes.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df in _scopes.pop():
            if not any(df is k for k in kept):
                forget(df)


def reachable(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless they have it."""
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in [*known.split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> list:
    """A 64-bit key of a row from its id and text; used together with the id itself."""
    return F.xxhash64(*[F.col(c) for c in cols])


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of at most 1,000 rows and with texts (column ``text``) of some
    ``SLICE_BYTES``, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (size + n > SLICE_BYTES or i - at == 1000):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, few of them at a time as Python objects."""
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).to_pylist()


def memo(name: str, make) -> dict:
    """This worker's cache of that name. A worker that takes up another operator's work drops what
    it has cached for the last one."""
    if name not in _caches:
        _caches.clear()
        _caches[name] = make()
    return _caches[name]


def fresh() -> None:
    """Drops what this worker has cached for another operator."""
    _caches.clear()
