"""A dashboard as a sink: every micro-batch becomes a frame of text.

The sink takes rows of section, name and value. Each task hands over, of every section, the rows and the sum of values and the
``top`` highest; the driver merges these and writes ``frame-<batch>.txt`` and the same as JSON, so what it holds is bounded
by sections and tasks, and a batch that is repeated gives the same frame again.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

Kept = dict[str, tuple[int, int, list[tuple[int, str]]]]


def merged(kept: Kept, section: str, rows: int, total: int, items: list[tuple[int, str]], top: int) -> None:
    n, s, best = kept.get(section, (0, 0, []))
    kept[section] = n + rows, s + total, heapq.nsmallest(top, best + items, key=lambda x: (-x[0], x[1]))


def text(kept: Kept, batch: int) -> str:
    lines = [f"batch {batch}"]
    for section in sorted(kept):
        _, total, best = kept[section]
        lines.append(f"{section} {total:>12,}")
        lines += [f"  {i}. {name:<18} {n:>10,} {n / total * 100 if total else 0.0:5.1f}%" for i, (n, name) in enumerate(best, 1)]
    return "\n".join(lines) + "\n"


@dataclass
class Part(WriterCommitMessage):
    kept: Kept


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, path: str, top: int):
        self.path, self.top = path, top

    def write(self, iterator: Iterator) -> Part:
        kept: Kept = {}
        for row in iterator:
            merged(kept, row.section, 1, row.value, [(row.value, row.name)], self.top)
        return Part(kept)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        kept: Kept = {}
        for part in filter(None, messages):
            for section, (n, total, best) in part.kept.items():
                merged(kept, section, n, total, best, self.top)
        where, at = fs.FileSystem.from_uri(self.path)
        where.create_dir(at, recursive=True)
        numbers = json.dumps({section: {name: n for n, name in best} for section, (_, _, best) in kept.items()})
        for kind, what in (("json", numbers), ("txt", text(kept, batchId))):
            with where.open_output_stream(f"{at}/frame-{batchId}.{kind}") as out:
                out.write(what.encode())

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        pass


class FrameSource(DataSource):
    """``writeStream.format("rillmark_frames").option("path", ...)``, of rows section, name and value."""

    @classmethod
    def name(cls) -> str:
        return "rillmark_frames"

    def streamWriter(self, schema, overwrite: bool) -> FrameWriter:  # noqa: N802
        return FrameWriter(self.options["path"], int(self.options.get("top", "5")))


def sections(counts: DataFrame, section: str, name: str, value: str) -> DataFrame:
    """Rows for the sink from any counts."""
    return counts.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("long").alias("value"))


def shown(counts: DataFrame, path: str, checkpoint: str, mode: str = "complete", top: int = 5, **trigger):
    """A running query whose every micro-batch is a frame in the folder ``path``."""
    counts.sparkSession.dataSource.register(FrameSource)
    writer = counts.writeStream.format("rillmark_frames").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).option("top", top)
    return (writer.trigger(**trigger) if trigger else writer).start()


def last_frame(spark: SparkSession, path: str, kind: str = "txt") -> str | None:
    """The newest frame as text (or "json"), or None."""
    where, at = fs.FileSystem.from_uri(path)
    found = [f for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith("frame-") and f.base_name.endswith(f".{kind}")]
    if not found:
        return None
    newest = max(found, key=lambda f: int(f.base_name.split("-")[1].split(".")[0]))
    with where.open_input_stream(newest.path) as data:
        return data.read().decode()
