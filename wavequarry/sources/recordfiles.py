"""A sink of record files with a commit: files of a bounded number of rows, one set of keys each, that count once they are in a manifest.

Tasks write files under names of their own attempt, and a part of the manifest that lists them. Committing writes one small file with the names
of the attempts that counted; a batch of a stream writes it under its number, so a batch that runs again replaces itself. What an
attempt that failed has left is in no manifest and isn't read. The driver holds a name a task, never a list of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from wavequarry.sources.byteranges import BATCH, filesystem

ROWS = 1024
DATA, PARTS, COMMITS = "data", "_manifest/parts", "_manifest/commits"


@dataclass
class Attempt(WriterCommitMessage):
    name: str


def runs(columns: list[pa.Array], n: int) -> list[tuple[int, int]]:
    """Stretches of rows that are equal in all columns."""
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in columns]
    new = np.zeros(n, dtype=bool)
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    starts = [0, *np.flatnonzero(new).tolist()] if n else []
    return list(zip(starts, [*starts[1:], n]))


class Writing:
    """Options: path, rows (of a file at most), keys (columns by which files differ; rows come sorted by them), kind (parquet, or text: the lines
    of a column ``value``)."""

    def __init__(self, options: dict):
        self.root, self.rows = options["path"].rstrip("/"), int(options.get("rows", ROWS))
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.kind = options.get("kind", "parquet")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = filesystem(self.root)
        name, files, held, key = uuid.uuid4().hex, [], [], None

        def close() -> None:
            nonlocal held
            if held:
                table = pa.Table.from_batches(held)
                folder = "/".join([DATA, *[f"{k}={quote(str(v), safe='')}" for k, v in zip(self.keys, key)]])
                fs.create_dir(f"{root}/{folder}", recursive=True)
                file = f"{folder}/part-{name}-{len(files):05d}.{'txt' if self.kind == 'text' else 'parquet'}"
                files.append({"attempt": name, "file": file, "rows": len(table), **{k: str(v) for k, v in zip(self.keys, key)}})
                with fs.open_output_stream(f"{root}/{file}") as out:
                    if self.kind == "text":
                        out.write("".join(f"{v or ''}\n" for v in table["value"].to_pylist()).encode("utf-8", "surrogatepass"))
                    else:
                        pa.parquet.write_table(table, out, compression="zstd")
                held = []

        try:
            n = 0
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(k)) for k in self.keys]
                for start, stop in runs(columns, len(batch)):
                    at = tuple(c[start].as_py() for c in columns)
                    if n and at != key:
                        close()
                        n = 0
                    key = at
                    while start < stop:
                        if n == self.rows:
                            close()
                            n = 0
                        held.append(batch.slice(start, min(self.rows - n, stop - start)))
                        start, n = start + len(held[-1]), n + len(held[-1])
            close()
            if files:
                fs.create_dir(f"{root}/{PARTS}", recursive=True)
                with fs.open_output_stream(f"{root}/{PARTS}/{name}.json") as out:
                    out.write("".join(json.dumps(f) + "\n" for f in files).encode())
        except BaseException:
            for f in files:
                self.drop(fs, f"{root}/{f['file']}")
            raise
        return Attempt(name if files else "")

    @staticmethod
    def drop(fs, path: str) -> None:
        if fs.get_file_info(path).type == pa.fs.FileType.File:
            fs.delete_file(path)

    def committed(self, messages: list, number: str) -> None:
        fs, root = filesystem(self.root)
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        with fs.open_output_stream(f"{root}/{COMMITS}/{number}.json") as out:
            out.write("".join(json.dumps({"attempt": m.name}) + "\n" for m in messages if m and m.name).encode())

    def dropped(self, messages: list) -> None:
        """Removes what the attempts have written."""
        fs, root = filesystem(self.root)
        for m in messages:
            part = f"{root}/{PARTS}/{m.name}.json" if m and m.name else None
            if part and fs.get_file_info(part).type == pa.fs.FileType.File:
                with fs.open_input_stream(part) as lines:
                    for line in lines.read().decode().splitlines():
                        self.drop(fs, f"{root}/{json.loads(line)['file']}")
                self.drop(fs, part)


class BatchFiles(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.of = Writing(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        return self.of.write(iterator)

    def commit(self, messages: list) -> None:
        self.of.committed(messages, uuid.uuid4().hex)

    def abort(self, messages: list) -> None:
        self.of.dropped(messages)


class StreamFiles(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.of = Writing(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        return self.of.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.of.committed(messages, f"batch-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.of.dropped(messages)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        raise ValueError("record_files is a sink; committed_files reads what it has written")

    def writer(self, schema: StructType, overwrite: bool) -> BatchFiles:
        return BatchFiles(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamFiles:
        return StreamFiles(dict(self.options))


def write_files(df: DataFrame, path: str, rows: int = ROWS, keys: list[str] | None = None, kind: str = "parquet") -> None:
    """``df`` as files of at most ``rows`` rows, in its order; a file holds one combination of ``keys``."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.write.format("record_files").mode("append").option("rows", rows).option("keys", ",".join(keys or [])).option("kind", kind).save(path)


def committed_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per file that counts: file, rows and its keys as strings."""
    commits = spark.read.schema("attempt string").json(f"{path}/{COMMITS}").distinct()
    return spark.read.json(f"{path}/{PARTS}").join(commits, "attempt", "left_semi").drop("attempt")


def spread(files: DataFrame) -> DataFrame:
    """Files dealt evenly to tasks; manifests alone are too small to be."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)


def committed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files that count, with their file. Tasks open the files that the manifest lists; the driver lists none."""
    files = committed_files(spark, path)
    first = files.select("file").first()
    if first is None:
        return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{DATA}").withColumn("file", F.lit("")).limit(0)
    schema = StructType([*spark.read.parquet(f"{path}/{first[0]}").schema.fields, StructField("file", StringType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        held, n = [], 0

        def together() -> list[pa.RecordBatch]:
            return pa.concat_tables(held, promote_options="permissive").combine_chunks().to_batches()

        for b in batches:
            for file in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{file}") as source:
                    table = pa.parquet.ParquetFile(source).read(use_threads=False)
                # a column that a file lacks is null there
                table = pa.table([table[c] if c in table.column_names else pa.nulls(len(table)) for c in names], names=names)
                held.append(table.append_column("file", pa.array([file] * len(table), pa.string())))
                n += len(table)
                if n >= BATCH:
                    yield from together()
                    held, n = [], 0
        if held:
            yield from together()

    return spread(files.select("file")).mapInArrow(run, schema)


def committed_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, value: each text file that counts as a whole, opened in tasks; the driver lists none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for b in batches:
            files = b.column(0).to_pylist()
            for i in range(0, len(files), 1000):
                texts = []
                for file in files[i : i + 1000]:
                    with fs.open_input_file(f"{root}/{file}") as source:
                        texts.append(source.read())
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 1000], pa.array(texts, pa.binary()).cast(pa.string())], names=["path", "value"])

    return spread(committed_files(spark, path).select("file")).mapInArrow(run, "path string, value string")


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Deletes the files that no commit lists, such as those of tasks that ran when their job failed; for times when nothing is written there."""
    kept = committed_files(spark, path).select(F.substring_index("file", "/", -1).alias("_name"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{DATA}").select("path", F.substring_index("path", "/", -1).alias("_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                Writing.drop(*filesystem(p))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})

    return files.join(kept, "_name", "left_anti").select("path").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
