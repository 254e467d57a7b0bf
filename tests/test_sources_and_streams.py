"""Byte ranges, committed record files, segmented scans, the readers' registry and streams with state, on tables that break naive ones."""

import glob
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import scan
from wavequarry.operators import sequence
from wavequarry.sources import byteranges, io, recordfiles, registry
from wavequarry.streaming import stream


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    records = [bytes([7] * 2 + [i % 256, i // 256]) for i in range(1000)]
    (tmp_path / "a.bin").write_bytes(b"".join(records))
    (tmp_path / "b.bin").write_bytes(b"\0\1\2\3")
    (tmp_path / "c.bin").write_bytes(b"")
    got = byteranges.byte_records(spark, str(tmp_path), 4, 2, task_bytes=404, suffix=".bin")
    assert got.rdd.getNumPartitions() == 10  # 1001 records, 101 a task
    rows = got.withColumn("name", F.substring_index("path", "/", -1)).orderBy("name", "acq").collect()
    assert [(r["name"], r["acq"], r["samples"]) for r in rows] == [("a.bin", i, [i % 256, i // 256]) for i in range(1000)] + [("b.bin", 0, [2.0, 3.0])]
    assert byteranges.byte_records(spark, f"file://{tmp_path}/b.bin", 4, 4).collect()[0]["samples"] == []
    assert byteranges.byte_records(spark, str(tmp_path), 4, suffix=".none").collect() == []
    with pytest.raises(Exception, match="isn't a multiple of 3"):
        byteranges.byte_records(spark, str(tmp_path), 3).collect()


def test_shards_are_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "a/b").otherwise("c").alias("split"))
    io.write_shards(io.shards(rows, "id", 64, 4, ["split"]), path, 64, ["split"])
    files = recordfiles.committed_files(spark, path).collect()
    assert sorted((f["split"], int(f["shard_id"]), f["rows"]) for f in files) == sorted([("a/b", i, 64 if i < 5 else 14) for i in range(6)] + [("c", i, 64 if i < 10 else 26) for i in range(11)])
    back = recordfiles.committed_rows(spark, path)
    assert back.groupBy("file").agg(F.countDistinct("split", "shard_id").alias("n")).where("n <> 1").isEmpty()
    assert sorted(r["id"] for r in back.collect()) == list(range(1000))
    first = next(f["file"] for f in files if f["split"] == "c" and f["shard_id"] == "0")
    assert [r["pos_in_shard"] for r in back.where(F.col("file") == first).orderBy("pos_in_shard").collect()] == list(range(64))


def test_failed_writes_leave_nothing_that_counts(spark, tmp_path):
    path = str(tmp_path / "files")
    recordfiles.write_files(spark.range(10), path, 4)

    @F.udf("long")
    def failing(i):
        if i == 700:
            raise ValueError("a record that can't be written")
        return i

    with pytest.raises(Exception, match="can't be written"):
        recordfiles.write_files(spark.range(0, 1000, 1, 4).select(failing("id").alias("id")), path, 100)
    assert sorted(r["id"] for r in recordfiles.committed_rows(spark, path).collect()) == list(range(10))
    recordfiles.drop_uncommitted(spark, path)
    assert len(glob.glob(f"{path}/data/*.parquet")) == recordfiles.committed_files(spark, path).count()
    assert sorted(r["id"] for r in recordfiles.committed_rows(spark, path).collect()) == list(range(10))


def test_segmented_scan_of_one_long_session(spark):
    """One session has most rows, and the blocks cut through it."""
    rng = random.Random(5)
    rows = [(g, t, rng.choice("aab?") if g else "a") for g, n in ((0, 5), (1, 3000), (None, 40), (2, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "g int, t int, label string").repartition(5)
    got = sequence.transitions(df, ["g"], ["t"], "label", F.col("label") == "?")
    want, cut = {}, {}
    for g in (0, 1, None, 2):
        last, since = None, None
        for pos, (_, t, label) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            changed = label != "?" and pos > 0 and label != last
            last = label if label != "?" else last
            since = pos if changed else since
            want[g, t] = (pos, changed)
            cut[g, t] = since is None or pos - since >= 3
    assert {(r["g"], r["t"]): (r["pos"], r["changed"]) for r in got.collect()} == want
    for block in (3, 7, 1 << 18):
        left = sequence.cut_transients(got, ["g"], 3, block)
        assert {(r["g"], r["t"]) for r in left.collect()} == {k for k, v in cut.items() if v}
    assert sequence.transitions(df.limit(0), ["g"], ["t"], "label", F.col("label") == "?").count() == 0


def test_ranks_and_running_numbers(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") * 7919 % 1009).alias("k"))
    got = scan.ranked(rows, ["g"], ["k"], "place").collect()
    for g in (True, False):
        assert [r["place"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])] == list(range(sum(r["g"] == g for r in got)))
    for block in (1, 10, 1 << 18):
        got = scan.numbered(rows, ["g"], "k", "place", block).collect()
        assert [r["place"] for r in sorted((r for r in got if r["g"]), key=lambda r: r["k"])] == list(range(334))


def test_lines_of_one_file_in_many_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    (tmp_path / "one.txt").write_text("\n".join(lines))
    (tmp_path / "two.txt").write_text("alone")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 5
        got = io.text_lines(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in sorted((r for r in got if r["name"] == "one.txt"), key=lambda r: r["line_no"])] == lines
    assert sorted(r["line_no"] for r in got) == sorted([*range(20_000), 0])


def test_registered_readers(spark):
    registry.register(spark)
    rows = spark.sql("""SELECT k, r.row, r.signal FROM VALUES ('bracketed', cast('h\\n[1, x]\\nno' AS binary), '{"header": 1}'), ('bytes', cast('abcd' AS binary), '{"record_bytes": 2}'),
        ('columns', cast('1;;3\\n;;4' AS binary), '{"delimiter": ";"}'), ('columns', cast(NULL AS binary), NULL) AS t(k, c, o), LATERAL read_record(k, c, o) r""").collect()
    assert sorted(map(tuple, rows)) == [("bracketed", 0, [1.0, None]), ("bytes", 0, [97.0, 98.0]), ("bytes", 1, [99.0, 100.0]), ("columns", 0, [1.0, None]), ("columns", 1, [3.0, 4.0])]
    with pytest.raises(Exception, match="no reader for kind"):
        spark.sql("SELECT * FROM read_record('other', cast('x' AS binary), '{}')").collect()
    with pytest.raises(ValueError, match="has a reader"):
        registry.reader("bytes")(lambda c, o: iter(()))


def arrive(spark, path, *rows):
    spark.createDataFrame(rows, "source string, at long, id long").coalesce(1).write.mode("append").parquet(path)


def test_earliest_record_after_a_restart(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        rows = stream.source(spark, path, spark.read.parquet(path).schema, 1)
        got = stream.available(stream.earliest_records(rows, "source", ["at", "id"]), out, "update")
        return sorted(map(tuple, got.groupBy("source").agg(F.min_by(F.struct("at", "id"), F.struct("at", "id")).alias("r")).select("source", "r.*").collect()))

    arrive(spark, path, ("a", 5, 1), ("a", 4, 9), ("b", 7, 7))
    arrive(spark, path, ("a", 4, 8), ("b", 9, 1))
    assert run() == [("a", 4, 8), ("b", 7, 7)]
    arrive(spark, path, ("a", 6, 0), ("b", 1, 1), ("c", 0, 0))
    assert run() == [("a", 4, 8), ("b", 1, 1), ("c", 0, 0)]


def test_a_source_that_was_silent_begins_anew(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*rows):
        arrive(spark, path, *rows)
        df = stream.source(spark, path, spark.read.parquet(path).schema, 1).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", "0 seconds")
        return sorted((r["source"], r["at"]) for r in stream.available(stream.earliest_records(df, "source", ["at", "id"], "time", 100_000), out, "update").collect())

    assert run(("a", 1000, 1), ("b", 1000, 1)) == [("a", 1000), ("b", 1000)]
    assert run(("b", 1090, 1), ("c", 1150, 1)) == [("a", 1000), ("b", 1000), ("c", 1150)]
    # the watermark is 150 s beyond a's last record and 60 s beyond b's
    assert run(("a", 1160, 1), ("b", 1160, 1)) == [("a", 1000), ("a", 1160), ("b", 1000), ("c", 1150)]


def test_buffered_files_of_a_stream_that_failed(spark, tmp_path):
    path, out, flag = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "flag")
    for i in range(3):
        spark.range(i * 500, i * 500 + 500, 1, 1).write.mode("append").parquet(path)

    @F.udf("long")
    def failing(i):
        if i == 1200 and not os.path.exists(flag):
            raise ValueError("stopped")
        return i

    def run():
        rows = stream.source(spark, path, spark.read.parquet(path).schema, 1).select(failing("id").alias("id"))
        stream.buffered_files(rows, out, str(tmp_path / "checkpoint"), 128).awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run()
    before = recordfiles.committed_rows(spark, out).count()
    assert before in (500, 1000)  # batches that were finished
    open(flag, "w").close()
    run()
    run()  # nothing new
    assert sorted(r["id"] for r in recordfiles.committed_rows(spark, out).collect()) == list(range(1500))
    assert sorted(f["rows"] for f in recordfiles.committed_files(spark, out).collect()) == [116] * 3 + [128] * 9


def test_a_batch_that_is_committed_again_replaces_itself(tmp_path):
    import pyarrow as pa

    sink = recordfiles.StreamFiles({"path": str(tmp_path / "x"), "rows": "10"})
    batch = pa.RecordBatch.from_pydict({"id": list(range(25))})
    first, second = sink.write(iter([batch])), sink.write(iter([batch]))
    sink.commit([first], 0)
    sink.commit([second, None], 0)
    commits = glob.glob(str(tmp_path / "x/_manifest/commits/*"))
    assert len(commits) == 1 and json.loads(open(commits[0]).read())["attempt"] == second.name
    sink.abort([first], 0)
    assert len(glob.glob(str(tmp_path / "x/data/*.parquet"))) == 3


def test_small_files_of_records_go_together(spark):
    """Many small files make few batches; each file's records are numbered for themselves, and empty files have none."""
    class Caught:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    many = pa.RecordBatch.from_pydict({"session": list(range(6000)), "channel": pa.array([0] * 6000, pa.int32()), "content": [b"x" * 24] * 6000})
    sizes = [len(b) for b in io.byte_records(Caught(), 8, 1)(iter([many]))]
    assert sum(sizes) == 18_000 and len(sizes) == 5
    rows = [(i, i % 2, bytes([i % 251] * 4 * (i % 4))) for i in range(3000)]
    got = io.byte_records(spark.createDataFrame(rows, "session long, channel int, content binary").coalesce(1), 4, 1)
    want = [(i, c, k, [float(i % 251)] * 3) for i, c, x in rows for k in range(len(x) // 4)]
    assert sorted((r["session"], r["channel"], r["acq"], r["samples"]) for r in got.collect()) == want


def test_committed_rows_of_many_files(spark, tmp_path):
    """Tasks read what the manifest lists: files without a commit aren't even opened, columns that some files lack are null there."""
    path = str(tmp_path / "out")
    recordfiles.write_files(spark.range(100).withColumn("k", (F.col("id") % 3).cast("int")).repartition(2, "k").sortWithinPartitions("k"), path, 7, ["k"])
    recordfiles.write_files(spark.range(100, 110).withColumn("k", F.lit(None).cast("int")).coalesce(1), path, 7, ["k"])
    (tmp_path / "out/data/k=0/part-left-00000.parquet").write_bytes(b"what a failed task has left")
    back = recordfiles.committed_rows(spark, path)
    assert sorted((r["id"], r["k"]) for r in back.collect()) == [(i, i % 3 if i < 100 else None) for i in range(110)]
    sizes = {r["file"]: r["count"] for r in back.groupBy("file").count().collect()}
    assert sizes == {r["file"]: r["rows"] for r in recordfiles.committed_files(spark, path).collect()} and max(sizes.values()) == 7
    assert len(sizes) == 5 * 3 + 2
