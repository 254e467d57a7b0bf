"""Readers of recordings and writers of corpora. Every reader emits an explicit order key."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavequarry.functions import arrays as A
from wavequarry.functions import scan
from wavequarry.functions.rank import exact_rank, seeded_key
from wavequarry.functions.scan import workspace  # noqa: F401
from wavequarry.sources import byteranges, recordfiles

#: Bytes of small files of records that are decoded at once.
TOGETHER = 1 << 20


def discover(spark: SparkSession, root: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, length of the files that match, unread."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(root).select("path", "length")


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, found, length of an explicit list of files: those that are missing are told, not an error. Folders are listed once each."""
    folders = sorted({p.rsplit("/", 1)[0] for p in paths})
    name = F.regexp_replace("path", "^file:/+", "/")
    there = spark.read.format("binaryFile").load(folders).select(name.alias("path"), "length")
    wanted = spark.createDataFrame([(p.removeprefix("file:").replace("//", "/"),) for p in sorted(set(paths))], "path string")
    return wanted.join(there, "path", "left").select("path", F.col("length").isNotNull().alias("found"), "length").orderBy("path")


def wide_channels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Channel columns to a row per channel; other columns stay."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.array(*columns)).alias("channel_idx", "signal"))


def demuxed(cells: DataFrame, n_channels: int, metadata_rows: int) -> DataFrame:
    """(row, col, val) of an interleaved matrix: column j is channel j % n of acquisition j div n; metadata rows go."""
    rows = cells.where(F.col("row") >= metadata_rows)
    return rows.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "val"))), lambda x: x["val"]).alias("signal")).select(F.floor(F.col("col") / n_channels).cast("int").alias("acq"), (F.col("col") % n_channels).cast("int").alias("channel_idx"), "signal")


def trace_columns(df: DataFrame, order: str) -> DataFrame:
    """Every column is a trace; columns without a value go."""
    traces = [c for c in df.columns if c != order]
    long = df.unpivot([order], traces, "trace", "val")
    rows = long.groupBy("trace").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "val"))), lambda x: x["val"]).alias("signal"), F.count("val").alias("n"))
    return rows.where("n > 0").drop("n")


def bracketed_text(lines: DataFrame, header: int) -> DataFrame:
    """lines: path, line_no, value. The vector between the first bracket and the last; row: a running number over the lines kept."""
    body = F.regexp_extract("value", r"\[(.*)\]", 1)
    rows = lines.where((F.col("line_no") >= header) & F.col("value").rlike(r"\[.*\]")).withColumn("signal", F.transform(F.split(body, ","), lambda v: F.trim(v).try_cast("double")))
    return scan.numbered(rows, ["path"], "line_no", "row").withColumn("row", F.col("row").cast("int")).drop("value")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of a file source with path and line_no: a file's rows lie in the order of its blocks, and within a block in that of reading.

    A task reads a block of a file from its start to its end, so a row's place in its block is its number in the task less the block's first
    one; the counts of the blocks before give the rest. No window spans a file. The rows are stored once, so that their numbers are those
    that the counts are of."""
    rows = scan.stored(rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i")), "lines")
    rows = scan.with_handed_on(rows, ["path"], _rows=(F.count(F.lit(1)), F.sum("_rows"))).join(
        rows.groupBy(F.col("path").alias("_path"), F.col("_block").alias("_of")).agg(F.min("_i").alias("_first")), (F.col("path") == F.col("_path")) & (F.col("_block") == F.col("_of")))
    return rows.withColumn("line_no", F.coalesce("_rows", F.lit(0)) + F.col("_i") - F.col("_first")).drop("_block", "_i", "_rows", "_path", "_of", "_first")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, value of text files."""
    return numbered_rows(spark.read.text(path)).select("path", "line_no", "value")


def without_last(signal: Column) -> Column:
    return F.slice(signal, F.lit(1), F.greatest(F.size(signal) - 1, F.lit(0)))


def plane_waves(df: DataFrame, signal: str, frame: str, stored: int = 800, used: int = 768) -> DataFrame:
    """n = size div stored slices of ``used`` samples, cut from the contiguous prefix; acq = frame * n + wave."""
    out = df.withColumn("n_pw", F.floor(F.size(signal) / stored).cast("int")).where("n_pw > 0")
    out = out.select("*", F.explode(A.indices(F.col("n_pw"))).alias("pw"))
    return out.withColumn(signal, F.slice(signal, F.col("pw") * used + 1, used)).withColumn("acq", F.col(frame) * F.col("n_pw") + F.col("pw"))


def acquisition(rank: int, frame: Column, wave: Column, n_waves: Column) -> Column:
    """Acquisition index of 4-, 3- and 2-dimensional channel data."""
    return {4: frame * n_waves + wave, 3: frame, 2: F.lit(0)}.get(rank, F.raise_error(F.lit(f"channel data of rank {rank}")).cast("int"))


def byte_records(files: DataFrame, bytes_per_acq: int, header: int) -> DataFrame:
    """files: session, channel, content. Fixed-size records without their header bytes, as floats; a size that doesn't divide is an error."""

    width = bytes_per_acq - header

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column(2).to_pylist()
            sizes = np.array([len(c) for c in contents], dtype=np.int64)
            for i in np.flatnonzero(sizes % bytes_per_acq)[:1].tolist():
                raise ValueError(f"size of session {b.column(0)[i]}, channel {b.column(1)[i]} isn't a multiple of {bytes_per_acq}")
            # small files go together, a large one alone
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TOGETHER)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
                counts = sizes[start:stop] // bytes_per_acq
                of = np.repeat(np.arange(start, stop), counts)
                acq = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                x = np.frombuffer(b"".join(contents[start:stop]), dtype=np.uint8).reshape(-1, bytes_per_acq)[:, header:]
                for i in range(0, len(of), byteranges.BATCH):
                    part, at = x[i : i + byteranges.BATCH].astype(np.float32), pa.array(of[i : i + byteranges.BATCH])
                    samples = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * np.int32(width)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(acq[i : i + byteranges.BATCH]), samples], names=["session", "channel", "acq", "samples"])

    return files.select(F.col("session").cast("long"), F.col("channel").cast("int"), "content").mapInArrow(run, "session long, channel int, acq long, samples array<float>")


def stacked_channels(records: DataFrame, kept: list[int]) -> DataFrame:
    """(session, acq) to one frame of the kept channels. Sessions that lack one are skipped; unequal record counts are an error."""
    rows = records.where(F.col("channel").isin(*kept))
    whole = rows.groupBy("session", "channel").agg(F.count(F.lit(1)).alias("n")).groupBy("session").agg(F.count(F.lit(1)).alias("channels"), F.min("n").alias("low"), F.max("n").alias("high")).where(F.col("channels") == len(kept))
    checked = whole.where(F.when(F.col("low") == F.col("high"), F.lit(True)).otherwise(F.raise_error(F.lit("channels differ in their number of records")).cast("boolean"))).select("session")
    frames = rows.join(checked, "session").groupBy("session", "acq").agg(F.array_sort(F.collect_list(F.struct("channel", "samples"))).alias("c"))
    return frames.select("session", "acq", F.transform("c", lambda c: c["samples"]).alias("signal"))


def block_labels(pos: Column, per_class: int) -> Column:
    return F.floor(pos / per_class).cast("int")


def labelled_frames(df: DataFrame, dofs: list[str], session: str, signal: str, keep: list[int] | None = None, augmented: str | None = None) -> DataFrame:
    """targets from columns by name, channels by index, augmented rows dropped on request."""
    if augmented:
        df = df.where(~F.col(augmented))
    picked = F.transform(F.array(*map(F.lit, keep)), lambda i: F.get(F.col(signal), i)) if keep is not None else F.col(signal)
    return df.withColumn("targets", F.array(*[F.col(c).cast("float") for c in dofs])).withColumn(signal, picked).withColumn("session_id", F.col(session))


def session_files(paths: DataFrame, task: str, sessions: list[str]) -> DataFrame:
    """path, task, session of files named ``{task}_{session}``; the session token has to match as a whole."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rows = paths.withColumn("task", F.regexp_extract(name, "^([^_]+)_", 1)).withColumn("session", F.regexp_extract(name, "^[^_]+_(.+)$", 1))
    return rows.where((F.col("task") == task) & F.col("session").isin(*sessions))


def write_tree(df: DataFrame, path: str) -> None:
    """One output tree per (format, split)."""
    df.write.partitionBy("format", "split").mode("error").parquet(path)


def shards(df: DataFrame, key: str, per_shard: int, seed: int, partition: list[str]) -> DataFrame:
    """shard_id and pos_in_shard: rows of a partition in seeded order, ``per_shard`` to a shard."""
    ranked = exact_rank(df.withColumn("_key", seeded_key(seed, "shard", key)), partition, "_key", [key], "_r")
    return ranked.withColumn("shard_id", F.floor(F.col("_r") / per_shard).cast("long")).withColumn("pos_in_shard", (F.col("_r") % per_shard).cast("int")).drop("_key", "_r")


def write_shards(df: DataFrame, path: str, per_shard: int, partition: list[str]) -> None:
    """A file for each shard of each partition, its records in order, committed by a manifest."""
    keys = [*partition, "shard_id"]
    # a number of tasks of its own: of rows this small adaptive execution would leave few tasks with all the files
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    recordfiles.write_files(dealt.sortWithinPartitions(*keys, "pos_in_shard"), path, per_shard, keys)


def offsets(df: DataFrame, key: str, signal: str) -> DataFrame:
    """start and stop of each signal in the concatenation by key. Blocks of keys hand on their total length, a window within a
    block gives the rest; no task sees the whole table, and the number of blocks grows with the session's partitions."""
    rows = scan.range_blocks(df.select(F.col(key), F.size(signal).cast("long").alias("length")), key)
    rows = scan.with_handed_on(rows, [], _before=(F.sum("length"), F.sum("_before")))
    inside = F.sum("length").over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("stop", inside + F.coalesce("_before", F.lit(0)))
    return out.select(key, "length", (F.col("stop") - F.col("length")).alias("start"), "stop")


def checked_frames(df: DataFrame, channels: int, samples: int, targets: int | None) -> DataFrame:
    """Fails on a frame of another shape or a label vector of another length."""
    good = (F.size("signal") == channels) & F.forall("signal", lambda c: F.size(c) == samples)
    if targets is not None:
        good = good & (F.size("targets") == targets)
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("frame of another shape")).cast("boolean")))


def manifest(df: DataFrame, config: str) -> DataFrame:
    """One row: totals, counts by source and by base and split, as JSON."""
    by = lambda *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct(*keys, "n"))).alias("x"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = total.crossJoin(F.broadcast(by("source_dataset").withColumnRenamed("x", "sources"))).crossJoin(F.broadcast(by("base_dataset", "split").withColumnRenamed("x", "splits")))
    return out.select(F.to_json(F.struct(F.lit(config).alias("config"), "total", "sources", "splits")).alias("manifest"))


def section(name: str, rows: DataFrame, keys: list[str], *counts: str) -> DataFrame:
    """section, key (a JSON object), n (a JSON object): one row for each combination of keys."""
    key = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    return rows.select(F.lit(name).alias("section"), key.alias("key"), F.to_json(F.struct(*counts)).alias("n"))


def etl_manifest(loaded: DataFrame, capped: DataFrame, split: DataFrame, config: dict, per_shard: int, seconds: dict[str, float]) -> DataFrame:
    """Sections of a run: its configuration, totals, counts by source and channel as loaded, by source and base before and
    after the cap, by base and split with their shards, and timing. loaded: source_dataset, base_dataset, channel_idx, kept."""
    n = F.count(F.lit(1)).alias("n")
    stage = loaded.groupingSets([["source_dataset", "channel_idx"], []], "source_dataset", "channel_idx").agg(n, F.count_if("kept").alias("kept"), F.grouping_id().alias("_g"))
    cap = lambda key: loaded.where("kept").groupBy(key).agg(n).withColumnRenamed("n", "before").join(capped.groupBy(key).agg(n).withColumnRenamed("n", "after"), key, "left").na.fill(0, ["after"])
    spark = loaded.sparkSession
    settings = spark.createDataFrame([(k, str(v)) for k, v in sorted(config.items())] or [("", "")], "name string, value string").where("name <> ''")
    timing = spark.createDataFrame([(k, float(v)) for k, v in sorted(seconds.items())] or [("", 0.0)], "stage string, seconds double").where("stage <> ''")
    out = section("config", settings, ["name"], "value").unionByName(section("seconds", timing, ["stage"], "seconds"))
    out = out.unionByName(section("total", stage.where("_g > 0"), [], "n", "kept")).unionByName(section("loaded", stage.where("_g = 0"), ["source_dataset", "channel_idx"], "n", "kept"))
    for key in ("source_dataset", "base_dataset"):
        out = out.unionByName(section(f"cap by {key}", cap(key), [key], "before", "after"))
    per = split.groupBy("split").agg(n).withColumn("shards", F.ceil(F.col("n") / per_shard).cast("long"))
    return out.unionByName(section("split", split.groupBy("base_dataset", "split").agg(n), ["base_dataset", "split"], "n")).unionByName(section("shards", per, ["split"], "n", "shards"))


def labelled_manifest(frames: DataFrame, label: str | None = "label", targets: str | None = None, k: int = 0) -> DataFrame:
    """Sections by session, patient and label, or, for vectors of k targets, statistics of each target."""
    n = F.count(F.lit(1)).alias("n")
    keys = ["session_id", "patient_id"] + ([label] if label else [])
    out = section("total", frames.agg(n), [], "n")
    for key in keys:
        out = out.unionByName(section(key, frames.groupBy(key).agg(n), [key], "n"))
    if targets:
        rows = frames.select(F.explode(F.array(*[F.struct(F.lit(i).alias("target"), F.get(F.col(targets), F.lit(i)).cast("double").alias("v")) for i in range(k)])).alias("x")).select("x.*")
        stats = rows.groupBy("target").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
        out = out.unionByName(section("targets", stats, ["target"], "n", "mean", "std", "min", "max"))
    return out


def metric_logs(spark: SparkSession, root: str) -> DataFrame:
    """grp, run, line_no and the columns of every ``group_*/run_*`` log. line_no: the place of a row in its file."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    rows = numbered_rows(rows)
    return rows.withColumn("grp", F.regexp_extract("path", r"(group_\d+)", 1)).withColumn("run", F.regexp_extract("path", r"(run_\d+)", 1)).drop("path")


def run_configs(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """grp, run and config (JSON) of every ``group_*/run_*`` configuration file; YAML is turned into JSON where PyYAML is there."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return configs_of(rows, not glob.endswith(".json"))


def write_run_configs(df: DataFrame, path: str) -> None:
    """group, run, value as a file for each run, committed by a manifest."""
    dealt = df.select("group", "run", "value").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run")
    recordfiles.write_files(dealt.sortWithinPartitions("group", "run"), path, 1, ["group", "run"], "text")


def committed_run_configs(spark: SparkSession, path: str) -> DataFrame:
    """``run_configs`` of what ``write_run_configs`` has written, however many files: the manifest lists them, not the driver."""
    return configs_of(recordfiles.committed_texts(spark, path), True)


def configs_of(files: DataFrame, yaml_files: bool) -> DataFrame:
    """files: path, value (the whole text)."""
    config = F.col("value")
    if yaml_files:

        @F.pandas_udf("string")
        def config_json(text: pd.Series) -> pd.Series:
            import yaml

            loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
            return text.map(lambda t: json.dumps(yaml.load(t, loader)))

        config = config_json("value")
    return files.select(F.regexp_extract("path", r"(group_\d+)", 1).alias("grp"), F.regexp_extract("path", r"(run_\d+)", 1).alias("run"), config.alias("config"))


def dig(config: Column, path: str) -> Column:
    return F.get_json_object(config, f"$.{path}")


def shard_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    per = df.groupBy(*keys, "shard_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("shards"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.sum("n").alias("total"))


def metadata_json(fixed: list[Column], free: Column) -> Column:
    """Fixed fields and a free map as one JSON object; fixed fields win."""
    names = [c for c in fixed]
    return F.to_json(F.map_concat(F.map_filter(free, lambda k, v: ~k.isin(*[c for c, _ in names])), F.create_map(*[x for c, v in names for x in (F.lit(c), v.cast("string"))])))


def tolerant(df: DataFrame, decoded: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``decoded``, quarantined rows): a record that can't be decoded doesn't end the job."""
    out = df.withColumn("decoded", decoded)
    return out.where("decoded IS NOT NULL"), out.where("decoded IS NULL").drop("decoded")


SIDECARS = ["mean", "std", "min", "max"]


def write_corpus(df: DataFrame, path: str, key: str, signal: str) -> None:
    """Signals with their statistics, start and stop; a missing rate is 0 there."""
    stats = [A.mean(F.col(signal)).alias("mean"), A.std(F.col(signal)).alias("std"), F.coalesce(F.array_min(signal), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(signal), F.lit(0.0)).alias("max")]
    rows = df.select("*", *stats).join(offsets(df, key, signal), key)
    (rows.withColumn("fs", F.coalesce("fs", F.lit(0.0))) if "fs" in rows.columns else rows).write.parquet(path)


def read_corpus(spark: SparkSession, path: str, need_stats: bool = False) -> DataFrame:
    """The corpus with its sidecar columns; without the statistics that normalisation needs it is an error."""
    df = spark.read.parquet(path)
    missing = set(SIDECARS) - set(df.columns)
    if need_stats and missing:
        raise ValueError(f"the corpus lacks {sorted(missing)}")
    return df


#: Readers by name: each makes rows of signals from rows as they are stored.
READERS = {"wide": wide_channels, "demux": demuxed, "traces": trace_columns, "bracketed": bracketed_text, "waves": plane_waves, "bytes": byte_records}


def read_as(kind: str, rows: DataFrame, **options) -> DataFrame:
    return READERS[kind](rows, **options)
