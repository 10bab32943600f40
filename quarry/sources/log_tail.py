"""The end of a rotated log, read from its last bytes, and a log that keeps a few files.

A log is a folder, or folders in it, of files whose paths sort by age, newest last. `tail` is a data source
whose partitions are ranges of bytes from the end of the newest files: the driver reads
ranges backwards, RANGE_BYTES each, until they hold enough line ends, and tasks read the
lines of those ranges. What is further back is not read, however long the log is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.operators.traces import masked_traces

RANGE_BYTES = 65_536
#: Files that a rotated log keeps, a fixed value, and records of a file at most.
KEPT_FILES, FILE_RECORDS = 5, 500_000
LINES = "file string, place long, line string"


@dataclass
class _Range(InputPartition):
    path: str
    start: int  # the first byte of a line
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """The files of a log, oldest first."""
    found = store.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class _TailReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.wanted = options["path"], int(options.get("lines", "20"))

    def partitions(self) -> list:
        store, folder = _open(self.path)
        files = _files(store, folder)
        found: list[_Range] = []
        missing = self.wanted
        for file in reversed(files):
            end = file.size
            with store.open_input_file(file.path) as source:
                while end > 0 and missing > 0:
                    start = max(0, end - RANGE_BYTES)
                    source.seek(start)
                    part = source.read(end - start)
                    if start > 0:  # begin behind the first line end, or go further back for one long line
                        cut = part.find(b"\n", 0, len(part) - 1)
                        while cut < 0 and start > 0:
                            start = max(0, start - RANGE_BYTES)
                            source.seek(start)
                            part = source.read(end - start)
                            cut = part.find(b"\n", 0, len(part) - 1) if start > 0 else -1
                        start += cut + 1
                        part = part[cut + 1 :]
                    found.append(_Range(file.path, start, end))
                    missing -= sum(1 for line in part.split(b"\n") if line.strip())
                    end = start
            if missing <= 0:
                break
        return found or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as source:
            source.seek(partition.start)
            part = source.read(partition.end - partition.start)
        places, lines, at = [], [], partition.start
        for line in part.split(b"\n"):
            if line.strip():
                places.append(at)
                lines.append(line.decode("utf-8", "replace"))
            at += len(line) + 1
        name = "/".join(partition.path.rsplit("/", 2)[-2:])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "place", "line"])


class LogTail(DataSource):
    """`spark.read.format("log_tail").option("lines", n).load(folder)`: at least the last n lines that aren't blank."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(self.options)


def tail(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """(file, place, line) of the last n lines of the log that aren't blank; fewer if it has fewer."""
    spark.dataSource.register(LogTail)
    rows = spark.read.format("log_tail").option("lines", str(n)).load(folder)
    return rows.orderBy(F.desc("file"), F.desc("place")).limit(n)


def tail_bytes(spark: SparkSession, folder: str, n: int) -> int:
    """The bytes that `tail` reads."""
    return sum(p.end - p.start for p in _TailReader({"path": folder, "lines": str(n)}).partitions())


def appended(traces: DataFrame, folder: str, number: int) -> None:
    """Writes records, masked, as JSON lines below the folder of `number` (a batch's, zero or more), in the place of what an
    earlier try has written there, and drops the oldest files beyond KEPT_FILES."""
    masked_traces(traces).write.mode("overwrite").option("maxRecordsPerFile", FILE_RECORDS).json(f"{folder}/{number:012d}")
    store, path = _open(folder)
    for old in _files(store, path)[:-KEPT_FILES]:
        store.delete_file(old.path)


def kept(stream: DataFrame, folder: str, checkpoint: str, every: str = "10 seconds"):
    """A query that appends the records of a stream to a rotated log."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: appended(rows, folder, batch_id)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
