"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that setting is absent: a fresh one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/wavequarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, str]]:
    """(row number, text) of a batch, one text at a time; null is empty."""
    for i, value in enumerate(batch.column(batch.schema.get_field_index(column))):
        yield i, value.as_py() or ""


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


class Hashes(dict):
    """word -> 64-bit hash. Words beyond ``limit`` are hashed but not remembered, so the memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit and len(word) < 64:
            self[word] = value
        return value


#: Words are what is left between ASCII white space; A-Z is folded.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], hashes: Hashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words where there are fewer than k; empty without words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    a = h[:n].copy()
    for j in range(1, k):
        a = mixed(a) + h[j : n + j]
    return np.unique(mixed(a))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): rows (id, component), component the smallest id reached; only ids that have links.

    Alternates large-star and small-star steps, each a grouped minimum (combined before the shuffle) and an equi-join,
    until all links are stars around roots. A component of any size is never held by one task.
    """

    def links(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").distinct()

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    now = stored(links(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    while True:
        # done where every node has one link, to a node without one
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("below")), F.struct(F.col("b").alias("id"), F.lit(None).cast("int").alias("below")))).alias("x")).select("x.*")
        odd = ends.groupBy("id").agg(F.sum("below").alias("links"), F.count(F.lit(1)).alias("n")).where("links > 1 OR links < n")
        if odd.isEmpty():
            break
        # large star: each larger neighbour of a node links to the node's smallest neighbour
        around = both(now)
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = links(around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        now = stored(links(small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("p")).select("p.*")), "links")
    star = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    roots = star.select("component").distinct().select(F.col("component").alias("id"), "component")
    return star.union(roots)
