"""Streams of signals: the batch projections over file streams, running counters, first records and an idempotent sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from wavequarry.functions import arrays as A
from wavequarry.operators.signal import chunks
from wavequarry.sources import recordfiles


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decoded(df: DataFrame, windows: list[int]) -> DataFrame:
    """One to one: sanitised, normalised by its own statistics, routed, with the time of each patch."""
    s = A.sanitized(F.col("signal").cast("array<double>"))
    out = df.withColumn("signal", s).withColumn("window_size", A.routed(F.col("sampling_frequency_hz"), windows))
    out = out.withColumn("patch_timestamps_us", A.midpoints_us(F.floor(F.size("signal") / F.col("window_size")), F.col("window_size"), F.col("sampling_frequency_hz")))
    return out.withColumn("signal", A.self_normalized(F.col("signal"), "zscore"))


def chunked(df: DataFrame, patch: int, per_chunk: int) -> DataFrame:
    """One to many: an explode, so it runs on streams."""
    return chunks(df, "signal", F.lit(patch), per_chunk)


def running_counts(df: DataFrame, key: str) -> DataFrame:
    bad = A.dead(A.sanitized(F.col("signal").cast("array<double>")))
    return df.groupBy(key).agg(F.sum((~bad).cast("long")).alias("kept"), F.sum(bad.cast("long")).alias("discarded"))


def first_records(df: DataFrame, key: str) -> DataFrame:
    """One record per key; the keys are few."""
    return df.dropDuplicates([key])


class Earliest(StatefulProcessor):
    """Keeps a key's earliest record by ``order`` and returns it whenever an earlier one comes. With a time column, a key is forgotten once the
    watermark is ``expiry_ms`` beyond its last record."""

    def __init__(self, schema: StructType, order: list[str], time: str | None, expiry_ms: int):
        self.schema, self.order, self.time, self.expiry = schema, order, time, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("earliest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, latest = None, None
        for part in rows:
            if len(part):
                best = part.sort_values(self.order, kind="stable").head(1)
                first = best if first is None else pd.concat([first, best]).sort_values(self.order, kind="stable").head(1)
                latest = max(x for x in (latest, part[self.time].max() if self.time else 0) if x is not None)
        if first is None:
            return
        if self.time:
            last = int(latest.timestamp() * 1000) + self.expiry
            for timer in list(self.handle.listTimers()):
                last = max(last, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last)
        row = tuple(v.item() if hasattr(v, "item") else v for v in first.iloc[0])
        places = [self.schema.names.index(c) for c in self.order]
        if not self.kept.exists() or tuple(row[i] for i in places) < tuple(self.kept.get()[i] for i in places):
            self.kept.update(row)
            yield first[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def earliest_records(df: DataFrame, key: str, order: list[str], time: str | None = None, expiry_ms: int = 0) -> DataFrame:
    """The earliest record of each key by ``order`` (which tells a key's records apart), whatever order they arrive in. In update mode; what the sink
    holds last for a key is its first record. The session's state store is set to RocksDB's. ``time`` needs a watermark; without it no key is forgotten."""
    df.sparkSession.conf.set(PROVIDER, ROCKS)
    return df.groupBy(key).transformWithStateInPandas(Earliest(df.schema, order, time, expiry_ms), df.schema, "Update", "eventTime" if time else "none")


def buffered_files(df: DataFrame, path: str, checkpoint: str, rows: int = recordfiles.ROWS) -> StreamingQuery:
    """Appends a stream to files of at most ``rows`` rows, committed batch by batch; a batch that runs again replaces itself."""
    df.sparkSession.dataSource.register(recordfiles.RecordFiles)
    return df.writeStream.format("record_files").option("rows", rows).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink whose batches overwrite their own folder, so a repeated batch is written once."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def label_statistics(df: DataFrame, label: str, *targets: str) -> DataFrame:
    """Running n, mean, population deviation, least and greatest value of each target by label."""
    each = df.select(label, F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("v")) for t in targets])).alias("x")).select(label, "x.*")
    return each.groupBy(label, "target").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what its sink holds: the batches (of appended or updated rows), or in complete mode the last one."""

    def last(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    sink = append_once(f"{path}/rows") if mode != "complete" else last
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def epoch_batches(shards: Column, per_shard: int, world: int, workers: int, batch: int) -> Column:
    """Batches of an epoch: full shards dealt to ranks and to the workers that get any; each of those has at least one batch."""
    active = F.greatest(F.least(F.lit(workers), shards), F.lit(1))
    of_each = F.floor(F.floor(shards * per_shard / max(1, world)) / (active * batch))
    return F.when((shards > 0) & F.lit(per_shard > 0), active * F.greatest(of_each, F.lit(1))).otherwise(1).cast("long")


def estimated_batches(shards: int, per_shard: int, world: int, workers: int, batch: int) -> int:
    """``epoch_batches`` of plain numbers."""
    if not shards or not per_shard:
        return 1
    active = max(min(workers, shards), 1)
    return active * max(shards * per_shard // max(1, world) // (active * batch), 1)
