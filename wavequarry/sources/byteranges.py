"""Fixed-size binary records as a data source: files are read in ranges of bytes, so one file of any size is read by many tasks.

Ranges begin and end at records, and small files share a task. Files are opened through ``pyarrow.fs``: local and shared folders, and the
stores that it knows by their URI. (For a store that only Spark can open, ``io.byte_records`` decodes what ``binaryFile`` reads.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a task; records of one batch.
TASK, BATCH = 64 << 20, 4096


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


@dataclass
class Ranges(InputPartition):
    """Parts of files: path, first record, number of records."""

    parts: list[tuple[str, int, int]]


class ByteRecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size, self.header = options["path"], int(options["record_bytes"]), int(options.get("header", 0))
        self.task = max(1, int(options.get("task_bytes", TASK)) // self.size)
        self.suffix = options.get("suffix", "")

    def partitions(self) -> list[Ranges]:
        fs, root = filesystem(self.root)
        info = fs.get_file_info(root)
        found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        out, parts, held = [], [], 0
        for f in sorted((f for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.size % self.size:
                raise ValueError(f"size of {f.path} isn't a multiple of {self.size}")
            start, n = 0, f.size // self.size
            while start < n:
                take = min(n - start, self.task - held)
                parts.append((f.path, start, take))
                start, held = start + take, held + take
                if held == self.task:
                    out.append(Ranges(parts))
                    parts, held = [], 0
        return out + [Ranges(parts)] if parts or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.root)
        width = self.size - self.header
        for path, start, n in partition.parts:
            with fs.open_input_file(path) as file:
                for first in range(start, start + n, BATCH):
                    k = min(BATCH, start + n - first)
                    file.seek(first * self.size)
                    x = np.frombuffer(file.read(k * self.size), dtype=np.uint8).reshape(k, self.size)[:, self.header :].astype(np.float32)
                    samples = pa.ListArray.from_arrays(pa.array(np.arange(0, k * width + 1, width, dtype=np.int32) if width else np.zeros(k + 1, np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array(np.arange(first, first + k)), samples], names=["path", "acq", "samples"])


class ByteRecords(DataSource):
    """Options: path, record_bytes, header (bytes of a record that go), suffix, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "byte_records"

    def schema(self) -> str:
        return "path string, acq long, samples array<float>"

    def reader(self, schema) -> ByteRecordReader:
        return ByteRecordReader(dict(self.options))


def byte_records(spark: SparkSession, path: str, record_bytes: int, header: int = 0, task_bytes: int = TASK, suffix: str = "") -> DataFrame:
    """path, acq (the record's number in its file), samples. A file whose size the record's doesn't divide is an error."""
    spark.dataSource.register(ByteRecords)
    return spark.read.format("byte_records").option("record_bytes", record_bytes).option("header", header).option("task_bytes", task_bytes).option("suffix", suffix).load(path)
