"""Registered queries of round trips, streams, manifests, experiment tables and predictions, each with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wavequarry.functions import arrays as A
from wavequarry.functions import filters, scan
from wavequarry.functions.rank import seeded_key
from wavequarry.operators import clean, evaluate, experiments, heads, layout, sampling, sequence, signal
from wavequarry.plans import fixtures as X
from wavequarry.plans.fixtures import LOGS, LONG, SAMPLES, SIG, table
from wavequarry.plans.queries import LAST, NORMALITY, SHARDS, SIZES, SLICES, SPLIT, cap_sql, h15_fillers, key_sql, query, r6, sharded_orders
from wavequarry.plans.queries import SQL as KNOWN
from wavequarry.sources import byteranges, io, recordfiles, registry
from wavequarry.streaming import stream

# ---- sources and sinks


@query("SELECT unnest(['absent.parquet', 'customer.parquet', 'orders.parquet']) AS name, unnest([false, true, true]) AS found")
def a1_discovery(spark, d):
    files = io.listed(spark, [f"{d}/{n}.parquet" for n in ("customer", "orders", "absent")])
    return files.select(F.substring_index("path", "/", -1).alias("name"), "found")


@query(f"""WITH {SIG}, {SPLIT}, f AS (SELECT sample_id, split, signal, unnest(['raw', 'interpolate']) AS format FROM sp JOIN sig USING (sample_id))
  SELECT sample_id, split, format, (CASE format WHEN 'raw' THEN len(signal) ELSE 20 END)::INT AS n FROM f""")
def a14_output_trees(spark, d):
    """Written as one tree per format and split, and read back."""
    s = X.signals(spark, d)
    rows = sampling.stratified_split(s.select("sample_id", "base_dataset"), "base_dataset", "sample_id").join(s.select("sample_id", "signal"), "sample_id")
    made = F.array(*[F.struct(F.lit(k).alias("format"), v.alias("signal")) for k, v in {"raw": F.col("signal"), "interpolate": A.interpolated(F.col("signal"), 20, force=True)}.items()])
    path = io.workspace(spark, "trees")
    io.write_tree(rows.select("sample_id", "split", F.explode(made).alias("f")).select("sample_id", "split", "f.*"), path)
    return io.read_corpus(spark, path).select("sample_id", "split", "format", F.size("signal").alias("n"))


@query(f"""WITH {SHARDS} SELECT 'split=' || split || '/shard_id=' || (k // 64) AS name, count(*)::INT AS n, sum(o_orderkey)::BIGINT AS keys, min(o_orderkey)::BIGINT AS least, arg_min(o_orderkey, k)::BIGINT AS first, arg_max(o_orderkey, k)::BIGINT AS last FROM r GROUP BY ALL""")
def a15_shard_files(spark, d):
    """Each shard is one file, which the manifest lists and whose records come back in order."""
    path = io.workspace(spark, "shards")
    io.write_shards(sharded_orders(spark, d), path, 64, ["split"])
    place = F.col("pos_in_shard")
    files = recordfiles.committed_rows(spark, path).groupBy("file").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderkey").alias("least"), F.min_by("o_orderkey", place).alias("first"), F.max_by("o_orderkey", place).alias("last"))
    return files.join(recordfiles.committed_files(spark, path).select("file", "rows"), "file").where("rows = n").select(F.regexp_extract("file", "^data/(.*)/[^/]*$", 1).alias("name"), "n", "keys", "least", "first", "last")


@query(f"""WITH {SIG}, {SPLIT}, c AS ({cap_sql(42, 'cap', '30').removeprefix(f'WITH {SIG}, ').replace('r AS (', 'SELECT sample_id, base_dataset, n FROM (').replace(') SELECT sample_id, base_dataset FROM r WHERE', ') WHERE')}),
  l AS (SELECT *, len(signal) > 4 AS kept FROM sig)
  SELECT 'total' AS section, NULL AS k1, NULL AS k2, count(*) AS n, count(*) FILTER (kept) AS m FROM l
  UNION ALL SELECT 'loaded', source_dataset, channel_idx::VARCHAR, count(*), count(*) FILTER (kept) FROM l GROUP BY ALL
  UNION ALL SELECT 'cap by base_dataset', b.base_dataset, NULL, b.n, coalesce(a.n, 0) FROM (SELECT base_dataset, count(*) AS n FROM l WHERE kept GROUP BY 1) b LEFT JOIN (SELECT base_dataset, count(*) AS n FROM c GROUP BY 1) a USING (base_dataset)
  UNION ALL SELECT 'split', base_dataset, split, count(*), NULL FROM sp GROUP BY ALL
  UNION ALL SELECT 'shards', split, NULL, count(*), ceil(count(*) / 16.0)::BIGINT FROM sp GROUP BY split
  UNION ALL SELECT 'config', 'cap', '30', NULL, NULL""")
def a18_run_manifest(spark, d):
    s = X.signals(spark, d).withColumn("kept", F.size("signal") > 4)
    capped = sampling.capped(s.select("sample_id", "base_dataset", "source_dataset"), "base_dataset", "sample_id", {"click": 30})
    split = sampling.stratified_split(s.select("sample_id", "base_dataset"), "base_dataset", "sample_id")
    m = io.etl_manifest(s, capped, split, {"cap": 30}, 16, {}).where("section <> 'cap by source_dataset'")
    k, n = (lambda p: F.get_json_object("key", f"$.{p}")), (lambda p: F.get_json_object("n", f"$.{p}").cast("long"))
    first = F.coalesce(k("source_dataset"), k("base_dataset"), k("name"), F.when(F.col("section") == "shards", k("split")))
    second = F.coalesce(k("channel_idx"), F.when(F.col("section") == "split", k("split")), F.get_json_object("n", "$.value"))
    return m.select("section", first.alias("k1"), second.alias("k2"), F.coalesce(n("before"), n("n")).alias("n"), F.coalesce(n("kept"), n("after"), n("shards")).alias("m"))


@query("""WITH f AS (SELECT 1 + vec_id % 6 AS s, vec_id % 4 AS p, label FROM embeddings)
  SELECT 'total' AS section, NULL AS key, count(*) AS n, NULL::DOUBLE AS mean, NULL::DOUBLE AS std FROM f UNION ALL SELECT 'session_id', s::VARCHAR, count(*), NULL, NULL FROM f GROUP BY s
  UNION ALL SELECT 'patient_id', p::VARCHAR, count(*), NULL, NULL FROM f GROUP BY p UNION ALL SELECT 'label', label::VARCHAR, count(*), NULL, NULL FROM f GROUP BY label
  UNION ALL SELECT 'targets', t::VARCHAR, count(*), round(avg(v), 6), round(stddev_pop(v), 6) FROM (SELECT 0 AS t, label::DOUBLE AS v FROM f UNION ALL SELECT 1, p FROM f) GROUP BY t""")
def a19_labelled_manifest(spark, d):
    f = X.frames(spark, d).withColumn("targets", F.array("label", "patient_id"))
    m = io.labelled_manifest(f, "label", "targets", 2)
    key = F.coalesce(*[F.get_json_object("key", f"$.{k}") for k in ("session_id", "patient_id", "label", "target")])
    return m.select("section", key.alias("key"), F.get_json_object("n", "$.n").cast("long").alias("n"), *[F.round(F.get_json_object("n", f"$.{c}").cast("double"), 6).alias(c) for c in ("mean", "std")])


def log_tree(spark, d) -> str:
    """The logs as ``group_*/run_*`` files."""
    logs = X.logs(spark, d).withColumn("group", F.concat(F.lit("group_"), F.substring("grp", 1, 1))).withColumn("run", F.concat(F.lit("run_"), "run"))
    path = io.workspace(spark, "logs")
    logs.select("group", "run", "line_no", "epoch", "acc").repartition("group", "run").sortWithinPartitions("group", "run", "line_no").drop("line_no").write.partitionBy("group", "run").option("header", True).csv(path)
    return path


@query(f"WITH {LOGS}, {LAST} SELECT 'group_' || grp[1] AS grp, 'run_' || run AS run, round(acc, 6) AS acc FROM la")
def a20_metric_logs(spark, d):
    """Logs written as files and read back with their line numbers; the metric of each run's last epoch."""
    rows = io.metric_logs(spark, log_tree(spark, d)).select("grp", "run", "line_no", F.col("epoch").try_cast("double").alias("epoch"), F.col("acc").try_cast("double").alias("acc"))
    return experiments.last_epoch(rows, ["grp", "run"], "epoch", "line_no", "acc").select("grp", "run", r6("acc", "acc"))


@query("SELECT 'group_' || (c_custkey % 7) AS grp, 'run_' || c_custkey AS run, (c_custkey % 3 / 10.0)::DOUBLE AS lr, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS encoder, NULL AS absent FROM customer")
def a20_run_configs(spark, d):
    """Nested configurations, one a customer, written as files, one a run, and read back by dotted paths."""
    c = table(spark, d, "customer")
    config = F.to_json(F.struct(F.struct((F.col("c_custkey") % 3 / 10).alias("lr"), F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("name")).alias("encoder")).alias("model")))
    path = io.workspace(spark, "configs")
    io.write_run_configs(c.select(F.concat(F.lit("group_"), F.col("c_custkey") % 7).alias("group"), F.concat(F.lit("run_"), "c_custkey").alias("run"), config.alias("value")), path)
    got = io.committed_run_configs(spark, path)
    return got.select("grp", "run", io.dig(F.col("config"), "model.lr").cast("double").alias("lr"), io.dig(F.col("config"), "model.encoder.name").alias("encoder"), io.dig(F.col("config"), "model.decay").alias("absent"))


@query(f"""WITH {SIG}, o AS (SELECT sample_id, fs, signal, (sum(len(signal)) OVER (ORDER BY sample_id))::BIGINT AS stop FROM sig)
  SELECT sample_id, coalesce(fs, 0) AS fs, stop - len(signal) AS start, stop, round(list_avg(signal), 6) AS mean, round(list_stddev_pop(signal), 6) AS std, list_min(signal) AS min, list_max(signal) AS max FROM o""")
def a24_ragged_corpus(spark, d):
    """Signals written with offsets and statistics, and read back for normalisation."""
    path = io.workspace(spark, "ragged")
    io.write_corpus(X.signals(spark, d).select("sample_id", "fs", "signal"), path, "sample_id", "signal")
    return io.read_corpus(spark, path, need_stats=True).select("sample_id", "fs", "start", "stop", r6("mean", "mean"), r6("std", "std"), "min", "max")


# ---- filters and labels


@query(f"WITH h AS ({KNOWN['h15_fillers']}), s AS (SELECT *, unnest(['train', 'val']) AS split FROM h) SELECT id, split, is_filler FROM s WHERE split = 'train' OR NOT is_filler")
def b10_fillers(spark, d):
    rows = h15_fillers(spark, d).select("id", "is_filler", F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    return clean.without_fillers(rows, F.col("split") == "val").select("id", "split", "is_filler")


SWEEP = "c AS (SELECT p_partkey, p_partkey % 2 = 0 AS u, p_partkey % 3 = 0 AS l, p_partkey % 5 < 2 AS f, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE 0.7 END AS decay FROM part)"


@query(f"""WITH {SWEEP} SELECT p_partkey, CASE WHEN u AND f THEN 'unfreezing of a frozen encoder' WHEN u AND l THEN 'unfreezing with adapters' WHEN l AND f THEN 'adapters of a frozen encoder'
  WHEN l AND coalesce(decay, 0) > 0 THEN 'adapters with a decay' WHEN f AND coalesce(decay, 0) > 0 THEN 'a frozen encoder with a decay' END AS reason FROM c""")
def b15_incompatible(spark, d):
    k = F.col("p_partkey")
    decay = F.when(F.col("p_size") % 3 == 1, 0.0).when(F.col("p_size") % 3 == 2, 0.7)
    combos = table(spark, d, "part").select("p_partkey", (k % 2 == 0).alias("unfreezing"), (k % 3 == 0).alias("lora"), (k % 5 < 2).alias("frozen"), decay.alias("decay"))
    return combos.select("p_partkey", experiments.reason(experiments.incompatible()).alias("reason"))


@query("""WITH c AS (SELECT p_partkey AS k, p_size % 7 AS s, p_partkey % 4 AS a, p_partkey % 9 AS b FROM part) SELECT k, unnest([x for x in [CASE WHEN s = 0 THEN 'shard' END, CASE WHEN a = 1 THEN 'ratios' END, CASE WHEN b = 2 THEN 'bandwidth' END,
  CASE WHEN b = 3 THEN 'length' END, CASE WHEN b IN (3, 4) AND a = 2 THEN 'mode' END, CASE WHEN s = 5 THEN 'interpolation' END, CASE WHEN a IN (0, 3) THEN 'centre' END] if x IS NOT NULL]) AS rule FROM c""")
def b16_config_rules(spark, d):
    s, a, b = F.col("p_size") % 7, F.col("p_partkey") % 4, F.col("p_partkey") % 9
    rows = table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.lit(64).alias("samples_per_shard"), F.when(s == 0, 48).otherwise(16).alias("batch_size"), F.lit(0.8).alias("train"), F.lit(0.1).alias("val"), F.when(a == 1, 0.2).otherwise(0.1).alias("test"),
        F.when(a == 0, 0.0).when(a != 3, 4e6).alias("tx_fc_hz"), F.when(b == 2, 1.5).when(b < 6, 0.5).alias("rf_bandwidth_fraction"), F.when(b == 3, 0).when(b == 4, 256).alias("truncate_signal_length"),
        F.when(a == 2, "middle").when(a == 1, "Left").alias("truncate_signal_mode"), F.when(s == 5, "top").when(s == 6, "Center").alias("interpolation_truncate_mode"),
    )
    return clean.violations(rows, clean.config_rules(True)).select("k", "rule")


# ---- predictions


PATCHES = f"""{SAMPLES}, pa AS (SELECT sample_id, base_dataset, pos // 8 AS chunk, (pos % 8) // 4 AS patch, v, v * (1 + ((pos % 3) - 1) / 10.0::DOUBLE) AS p FROM smp WHERE pos < n // 4 * 4),
  ma AS (SELECT DISTINCT sample_id, chunk, patch, substr({key_sql(11, 'visible', 'sample_id', 'chunk', 'patch')}, 1, 1) < '8' AS masked FROM pa)"""


def patch_tables(spark, d):
    """Targets and predictions by signal, chunk and patch, and the mask over them."""
    s = X.signals(spark, d).withColumn("pred", F.transform("signal", lambda v, i: v * (1 + (i % 3 - 1) / 10)))
    both = [signal.patch_rows(signal.chunks(s.select("sample_id", "base_dataset", F.col(c).alias("x")), "x", F.lit(4), 2), "x", 4) for c in ("signal", "pred")]
    targets, predictions = (b.select("sample_id", "base_dataset", F.col("chunk_index").alias("chunk"), F.col("patch_index").alias("patch"), F.col("patch").alias("x")) for b in both)
    key = ["sample_id", "chunk", "patch"]
    masks = targets.select(*key, (F.substring(seeded_key(11, "visible", *key), 1, 1) < "8").alias("masked"))
    return targets.withColumnRenamed("x", "target"), predictions.drop("base_dataset").withColumnRenamed("x", "prediction"), masks, key


@query(f"WITH {PATCHES} SELECT sample_id, chunk::INT AS chunk, patch::INT AS patch, masked, round(sum((v - p) * (v - p)), 6) AS sse FROM pa JOIN ma USING (sample_id, chunk, patch) GROUP BY ALL")
def c8_aligned_patches(spark, d):
    targets, predictions, masks, key = patch_tables(spark, d)
    rows = evaluate.aligned(targets, predictions, masks, key)
    return rows.select(*key, "masked", r6(A.total(F.zip_with("target", "prediction", lambda a, b: (a - b) * (a - b))), "sse"))


@query(f"""WITH {PATCHES}, st AS (SELECT sample_id, chunk, patch, avg(v) AS m, greatest(stddev_samp(v), 1e-6) AS s FROM pa GROUP BY ALL),
  x AS (SELECT base_dataset AS base, (v - m) / s AS t, p FROM pa JOIN ma USING (sample_id, chunk, patch) JOIN st USING (sample_id, chunk, patch) WHERE masked)
  SELECT base, count(*) AS n, round(sum(t), 4) + 0.0 AS st, round(sum(p), 4) AS sp, round(sum(t * t), 4) AS stt, round(sum(t * p), 4) AS stp, round(sum((t - p) * (t - p)), 4) AS sse FROM x GROUP BY GROUPING SETS ((base), ())""")
def d9_patch_sums(spark, d):
    """Statistics of masked patches whose targets are normalised patch by patch."""
    targets, predictions, masks, key = patch_tables(spark, d)
    rows = evaluate.aligned(targets, predictions, masks, key).where("masked").withColumnRenamed("base_dataset", "base")
    sums = evaluate.patch_sums(rows, "target", "prediction", "base", normalize=True)
    return sums.select("base", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("st", "sp", "stt", "stp", "sse")])


@query(f"""WITH {LONG}, c AS (SELECT sample_id, len(signal) AS n, unnest(range(greatest(1, ceil(len(signal) / 64.0)::INT))) AS i FROM sig)
  SELECT sample_id, i::INT AS chunk_index, (least(n - i * 64, 64) // 8)::INT AS valid, (least(n - i * 64, 64) // 8)::INT AS actual FROM c""")
def d32_valid_patches(spark, d):
    """Patches of each chunk as computed from the length, and as counted in the chunks."""
    s = X.long_signals(spark, d).select("sample_id", "signal")
    told = s.select("sample_id", F.posexplode(signal.valid_patches(F.size("signal"), 8, 8)).alias("chunk_index", "valid"))
    made = signal.chunks(s, "signal", F.lit(8), 8, 0).select("sample_id", "chunk_index", F.size(A.patches(F.col("signal"), 8)).alias("actual"))
    return told.join(made, ["sample_id", "chunk_index"], "left").select("sample_id", "chunk_index", "valid", "actual")


HEAD_SHIFT = "agreement", "accuracy"


@query("""WITH h AS (SELECT k, i, ((3 * k + 5 * i) % 11 - 5) / 4.0::DOUBLE AS w FROM (SELECT unnest(range(10)) AS k), (SELECT unnest(range(64)) AS i)),
  x AS (SELECT vec_id, label, vec_id % 2 = 1 AS test, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
  z AS (SELECT vec_id, label, k, sum(w * v) AS z FROM x JOIN h USING (i) WHERE test GROUP BY ALL), r AS (SELECT vec_id, label, arg_max(k, z) AS region FROM z GROUP BY ALL),
  c AS (SELECT label, i, avg(v) AS v FROM x WHERE test GROUP BY ALL), cz AS (SELECT label, k, sum(w * v) AS z FROM c JOIN h USING (i) GROUP BY ALL), cr AS (SELECT label, arg_max(k, z) AS home FROM cz GROUP BY label)
  SELECT label AS class, round(avg((region = home)::INT), 6) AS agreement, round(avg((region = label)::INT), 6) AS accuracy FROM r JOIN cr USING (label) GROUP BY label""")
def d18_agreement(spark, d):
    from wavequarry.plans.queries import WEIGHTS

    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("vec_id") % 2 == 0, "val").otherwise("test").alias("split"))
    return evaluate.centroid_shift(e, "split", "label", "x", WEIGHTS, [0.0] * 10).select("class", *[r6(c, c) for c in HEAD_SHIFT])


@query(f"""WITH {NORMALITY}, x AS (SELECT label, vec_id % 3 = 0 AS g, i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), m AS (SELECT label, i, avg(v) AS m FROM x WHERE g GROUP BY ALL),
  s AS (SELECT avg((v - m) * (v - m)) AS sim FROM x JOIN m USING (label, i) WHERE NOT g), t AS (SELECT avg(v) AS stat FROM st)
  SELECT round(sim, 5) AS similarity, round(stat, 5) AS normality, round(0.9 * sim + 0.1 * stat, 5) AS objective FROM s, t""")
def d29_d28_objective(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 == 0).alias("g"), "embedding")
    return evaluate.embedding_objective(e, "label", "g", "embedding", SLICES, 0.1).select(*[F.round(c, 5).alias(c) for c in ("similarity", "normality", "objective")])


@query(None)
def d30_axes(spark, d):
    """Each embedding on the two leading discriminant axes of its class and split."""
    e = table(spark, d, "embeddings").select("vec_id", F.concat_ws("/", "label", F.when(F.col("vec_id") % 2 == 0, "val").otherwise("test")).alias("group"), F.col("embedding").cast("array<double>").alias("x"))
    axes = evaluate.discriminant_axes(evaluate.scatter(e, "group", "x"), 64)
    first, second = evaluate.projected_2d(F.col("x"), axes.tolist())
    return e.select("vec_id", "group", first.alias("first"), second.alias("second"))


# ---- sampling


@query(f"""WITH c AS ({cap_sql(49, 'subset', '25')}) SELECT sample_id, base_dataset, row_number() OVER (ORDER BY sample_id) - 1 AS place FROM c""")
def h8_fixed_subset(spark, d):
    s = X.signals(spark, d).select("sample_id", "base_dataset")
    return sampling.sample(s, "fixed", stratum="base_dataset", dominating="click", k=25, key="sample_id", seed=42, salt=7).select("sample_id", "base_dataset", "place")


@query(f"""SELECT 'dynamic' AS strategy, base_dataset, count(*) AS n FROM ({cap_sql(45, 'epoch', '25')}) GROUP BY ALL UNION ALL SELECT 'proportional', base_dataset, count(*) FROM ({cap_sql(42, 'cap', '(SELECT floor(0.1 * count(*)) FROM sig)')}) GROUP BY ALL""")
def d23_items_by_strategy(spark, d):
    s = X.signals(spark, d).select("sample_id", "base_dataset")
    made = {"dynamic": sampling.sample(s, "dynamic_epoch", stratum="base_dataset", dominating="click", k=25, key="sample_id", seed=42, epoch=3), "proportional": sampling.sample(s, "proportional", stratum="base_dataset", dominating="click", ratio=0.1, key="sample_id")}
    one, two = (v.groupBy("base_dataset").agg(F.count(F.lit(1)).alias("n")).withColumn("strategy", F.lit(k)) for k, v in made.items())
    return one.unionByName(two)


@query(f"WITH {SIG}, {SIZES} SELECT split, sum(size)::BIGINT AS n, ceil(sum(size) / 16.0)::BIGINT AS shards FROM (SELECT s AS split, size FROM al) GROUP BY split")
def d4_split_shards(spark, d):
    n = X.signals(spark, d).groupBy("base_dataset").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.array(*[F.struct(F.lit(k).alias("split"), v.alias("size")) for k, v in sampling.allocation(F.col("n"), sampling.SPLITS).items()])
    return n.select(F.explode(sizes).alias("x")).groupBy("x.split").agg(F.sum("x.size").alias("n")).withColumn("shards", F.ceil(F.col("n") / 16).cast("long"))


# ---- signals


@query(f"""WITH {SIG}, f AS (SELECT sample_id, base_dataset, signal, unnest(['raw', 'interpolate']) AS format FROM sig)
  SELECT sample_id, format, (CASE WHEN format = 'raw' AND base_dataset = 'click' THEN least(len(signal), 6) ELSE len(signal) END)::INT AS n,
  round(list_sum(CASE WHEN format = 'raw' AND base_dataset = 'click' THEN signal[greatest(len(signal) - 5, 1) :] ELSE signal END), 6) AS total FROM f""")
def i2_truncated_formats(spark, d):
    params = spark.createDataFrame([("click", 6, "right"), ("view", None, "left")], "base_dataset string, truncate_signal_length int, truncate_signal_mode string")
    rows = X.signals(spark, d).select("sample_id", "base_dataset", "signal", F.explode(F.array(F.lit("raw"), F.lit("interpolate"))).alias("format"))
    return signal.truncated_formats(rows, "signal", params).select("sample_id", "format", F.size("signal").alias("n"), r6(A.total(F.col("signal")), "total"))


@query(f"""WITH {SIG}, s AS (SELECT sample_id, fs, len(signal) AS n FROM sig WHERE fs > 0), p AS (SELECT *, unnest(range(5)) AS i FROM s)
  SELECT sample_id, i::INT AS i, round((i * 4 + 2.0) * CASE WHEN n = 20 THEN 1 ELSE (n - 1) / 19.0::DOUBLE END / fs * 1e6, 6) AS us FROM p""")
def i12_resampled_midpoints(spark, d):
    s = X.signals(spark, d).withColumn("n", F.size("signal")).withColumn("signal", A.interpolated(F.col("signal"), 20, force=True))
    m = A.midpoints_us(F.floor(F.size("signal") / 4), F.lit(4), F.col("fs"), scale=A.resampling(F.col("n"), F.size("signal")))
    return s.select("sample_id", F.posexplode(m).alias("i", "us")).select("sample_id", "i", r6("us", "us"))


@query(f"""WITH {SAMPLES}, w AS (SELECT sample_id, n, pos, v, least(n, 32) AS m FROM smp), k AS (SELECT *, unnest(range(m // 2 + 1)) AS k FROM w),
  g AS (SELECT *, CASE WHEN k = 0 THEN 1 WHEN m % 2 = 0 AND k = m // 2 THEN CASE WHEN n > 32 THEN 2 ELSE 1 END ELSE 2 END AS g FROM k), j AS (SELECT *, unnest(range(32)) AS j FROM g)
  SELECT sample_id, j::INT AS pos, round(sum(v * g * cos(2 * pi() * k * (j / 32.0::DOUBLE - pos / n::DOUBLE))) / any_value(n), 5) + 0.0 AS v FROM j GROUP BY sample_id, j""")
def i4_fourier_values(spark, d):
    s = X.signals(spark, d).select("sample_id", F.posexplode(signal.fourier_resampled(F.col("signal").cast("array<double>"), 32)).alias("pos", "v"))
    return s.select("sample_id", "pos", (F.round("v", 5) + 0.0).alias("v"))


@query(f"""WITH {SAMPLES}, k AS (SELECT sample_id, n, pos, v, unnest(range(n // 2 + 1)) AS k FROM smp), g AS (SELECT *, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS g FROM k), j AS (SELECT *, unnest(range(n)) AS j FROM g)
  SELECT sample_id, j::INT AS pos, round(sqrt(sum(v * g * cos(2 * pi() * k * (j - pos) / n)) ** 2 + sum(v * g * sin(2 * pi() * k * (j - pos) / n)) ** 2) / any_value(n), 5) AS v FROM j GROUP BY sample_id, j""")
def i7_envelope(spark, d):
    s = X.signals(spark, d).select("sample_id", F.posexplode(signal.envelope(F.col("signal").cast("array<double>"))).alias("pos", "v"))
    return s.select("sample_id", "pos", F.round("v", 5).alias("v"))


# ---- filters against SQL: matrices of whole signals, and the recursion itself

N = 24
RESAMPLED = f"""{SIG}, grid AS (SELECT sample_id, fs, signal, len(signal) AS n, unnest(range({N})) AS j FROM sig), spot AS (SELECT *, j * (n - 1) / {N - 1}.0::DOUBLE AS p FROM grid), low AS (SELECT *, least(floor(p)::INT, n - 1) AS lo FROM spot),
  x AS (SELECT sample_id, fs, list(signal[lo + 1] + (signal[least(lo + 1, n - 1) + 1] - signal[lo + 1]) * (p - lo) ORDER BY j) AS x FROM low GROUP BY sample_id, fs)"""
#: The quadrature of a signal of N (even) samples: a circular convolution with cotangents at odd distances.
QUADRATURE = f"list(CASE WHEN (i - j) % 2 = 0 THEN 0 ELSE 2 / {N}.0::DOUBLE / tan(pi() * (i - j) / {N}.0::DOUBLE) END ORDER BY j)"


def resampled(spark, d):
    return X.signals(spark, d).select("sample_id", "fs", A.interpolated(F.col("signal").cast("array<double>"), N, force=True).alias("signal"))


def dense_bandpass(fs: float, order: int = 2) -> np.ndarray:
    """The zero-phase filter of N samples as a matrix, from its impulse response alone: both orders of passes, and the end states by normal equations."""
    b, a = filters.butterworth_coefficients(order, 2 * 1.4e6 / fs, 2 * min(2.6e6, 0.999 * fs / 2) / fs, "band")
    m, h = len(a) - 1, np.zeros(N)
    for k in range(N):
        h[k] = (b[k] if k <= m else 0.0) - sum(a[i] * h[k - i] for i in range(1, min(k, m) + 1))
    f = np.array([[h[i - j] if i >= j else 0.0 for j in range(N)] for i in range(N)])
    o = np.zeros((N, m))  # without input, state k is what would be added at sample k, were there no feedback
    for k in range(m):
        o[k:, k] = np.r_[1.0, np.zeros(N - 1)][: N - k]
        for i in range(k, N):
            o[i, k] -= sum(a[j] * o[i - j, k] for j in range(1, min(i, m) + 1))
    r = np.eye(N)[::-1]
    fb, bf, back = r @ f @ r @ f, f @ r @ f @ r, r @ f @ r @ o
    both = np.hstack([back - o, r @ o - r @ back])
    return fb + np.hstack([back, r @ o]) @ np.linalg.lstsq(both, bf - fb, rcond=None)[0]


def matrix_sql() -> str:
    rows = ", ".join(f"({fs}, {i}, {[float(v) for v in row]})" for fs in (8e6, 12e6, 20e6, 40.96e6) for i, row in enumerate(dense_bandpass(fs)))
    return f"(VALUES {rows}) AS g(fs, i, w)"


BANDPASSED = f"""{RESAMPLED}, band AS (SELECT sample_id, x.fs, any_value(x) AS x, list(list_dot_product(w::DOUBLE[], x) ORDER BY i) AS y FROM x JOIN {matrix_sql()} ON g.fs = x.fs GROUP BY sample_id, x.fs
    UNION ALL SELECT sample_id, fs, x, x FROM x WHERE fs IS NULL),
  q AS (SELECT i, {QUADRATURE} AS q FROM (SELECT unnest(range({N})) AS i), (SELECT unnest(range({N})) AS j) GROUP BY i),
  env AS (SELECT sample_id, list(sqrt(y[i + 1] ** 2 + list_dot_product(q, y) ** 2) ORDER BY i) AS e FROM band, q GROUP BY sample_id)"""


@query(f"WITH {BANDPASSED} SELECT sample_id, unnest(range({N}))::INT AS pos, round(unnest(y), 4) + 0.0 AS v FROM band WHERE fs IS NOT NULL")
def i6_bandpass_values(spark, d):
    """Of second order, whose end states 24 samples determine well."""
    s = resampled(spark, d).where("fs IS NOT NULL")
    low, high = A.band_edges(F.lit(2e6), F.col("fs"), 0.6)
    return s.select("sample_id", F.posexplode(signal.bandpass(F.col("signal"), F.col("fs"), low, high, 2)).alias("pos", "v")).withColumn("v", F.round("v", 4) + 0.0)


@query(f"""WITH {BANDPASSED}, f AS (SELECT sample_id, 'raw' AS format, x AS v FROM band UNION ALL SELECT sample_id, 'bandpass', y FROM band UNION ALL SELECT sample_id, 'envelope', e FROM env UNION ALL SELECT sample_id, 'interpolate', x[1:16] FROM band)
  SELECT sample_id, format, unnest(range(len(v)))::INT AS pos, round(unnest(v), 4) + 0.0 AS v FROM f""")
def i8_format_values(spark, d):
    s = resampled(spark, d).select("sample_id", F.col("fs").alias("fs_hz"), F.lit(2e6).alias("fc_hz"), "signal")
    return signal.formats(s, "signal", 16, 2).select("sample_id", "format", F.posexplode("signal").alias("pos", "v")).withColumn("v", F.round("v", 4) + 0.0)


@query(f"WITH {BANDPASSED} SELECT sample_id, unnest(range(16))::INT AS pos, round(unnest(e[1:16]), 4) + 0.0 AS v FROM env JOIN band USING (sample_id) WHERE fs IS NOT NULL")
def i9_chain_values(spark, d):
    s = resampled(spark, d).where("fs IS NOT NULL")
    low, high = A.band_edges(F.lit(2e6), F.col("fs"), 0.6)
    return signal.preprocessed(s, "signal", F.col("fs"), low, high, 16, True, 2).select("sample_id", F.posexplode("signal").alias("pos", "v")).withColumn("v", F.round("v", 4) + 0.0)


def kinds_sql() -> str:
    """Coefficients of second-order filters of each kind with edges at 0.2 and 0.5, states and extensions, as rows."""
    rows = []
    for kind in ("low", "high", "band", "stop"):
        b, a = filters.butterworth_coefficients(2, 0.2, 0.5, kind)
        rest = [b[i] - a[i] * b.sum() / a.sum() for i in range(1, len(a))]
        z = [sum(rest[i:]) for i in range(len(rest))]
        fill = lambda v, n: [float(x) for x in v] + [0.0] * (n - len(v))
        rows.append(f"('{kind}', {fill(b, 5)}::DOUBLE[], {fill(a, 5)}::DOUBLE[], {fill(z, 4)}::DOUBLE[], {3 * len(a)})")
    return f"(VALUES {', '.join(rows)}) AS k(kind, b, a, z, pad)"


def recursion_sql(name: str, source: str) -> str:
    """One pass sample by sample: the output and the four states behind each sample."""
    y = "k.b[1] * e.x[r.i + 1] + r.s1"
    steps = [f"r.s{j + 1} + k.b[{j + 1}] * e.x[r.i + 1] - k.a[{j + 1}] * ({y})" if j < 4 else f"k.b[5] * e.x[r.i + 1] - k.a[5] * ({y})" for j in range(1, 5)]
    return f"""{name} AS (SELECT sample_id, kind, 0 AS i, NULL::DOUBLE AS y, z[1] * x[1] AS s1, z[2] * x[1] AS s2, z[3] * x[1] AS s3, z[4] * x[1] AS s4 FROM {source} JOIN {kinds_sql()} USING (kind)
    UNION ALL SELECT r.sample_id, r.kind, r.i + 1, {y}, {', '.join(steps)} FROM {name} r JOIN {source} e ON e.sample_id = r.sample_id AND e.kind = r.kind JOIN {kinds_sql()} ON k.kind = r.kind WHERE r.i < len(e.x))"""


@query(f"""WITH RECURSIVE {RESAMPLED}, ext AS (SELECT sample_id, kind, list_concat(list_concat([2 * x[1] - x[k + 1] for k in range(pad, 0, -1)], x), [2 * x[{N}] - x[{N} - k] for k in range(1, pad + 1)]) AS x FROM x, {kinds_sql()}),
  {recursion_sql('one', 'ext')}, turned AS (SELECT sample_id, kind, list(y ORDER BY i DESC) AS x FROM one WHERE i > 0 GROUP BY ALL), {recursion_sql('two', 'turned')},
  passed AS (SELECT sample_id, kind, list(y ORDER BY i DESC) AS y FROM two WHERE i > 0 GROUP BY ALL)
  SELECT sample_id, kind, unnest(range({N}))::INT AS pos, round(unnest(y[pad + 1 : pad + {N}]), 4) + 0.0 AS v FROM passed JOIN {kinds_sql()} USING (kind)""")
def i25_filter_kinds(spark, d):
    """Second-order low-, high-, band-pass and band-stop filters over oddly extended signals."""
    s = resampled(spark, d)
    made = [s.select("sample_id", F.lit(kind).alias("kind"), F.posexplode(signal.butterworth(F.col("signal"), F.lit(2.0), F.lit(0.2), F.lit(0.5), kind, 2)).alias("pos", "v")) for kind in ("low", "high", "band", "stop")]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.withColumn("v", F.round("v", 4) + 0.0)


# ---- streams over all that is there


def embedding_stream(spark, d):
    """Embeddings as a stream of signals with a rate. The stream reads a folder of files, which a table of a single file is none; in two batches,
    each with a file for every second core."""
    path, e = io.workspace(spark, "arrived"), table(spark, d, "embeddings")
    files = max(4, spark.sparkContext.defaultParallelism)
    e.repartition(files, "vec_id").write.parquet(path)
    rows = stream.source(spark, path, e.schema, -(-files // 2))
    return rows.select("vec_id", "label", F.col("embedding").alias("signal"), F.when(F.col("vec_id") % 5 == 0, 8e6).when(F.col("vec_id") % 5 == 1, 20e6).when(F.col("vec_id") % 5 == 2, 40.96e6).alias("sampling_frequency_hz"))


EMB = "em AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e, CASE vec_id % 5 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 8 END AS w, CASE vec_id % 5 WHEN 0 THEN 8e6 WHEN 1 THEN 20e6 WHEN 2 THEN 40.96e6 END AS fs FROM embeddings)"


@query(f"WITH {EMB} SELECT vec_id, w AS window_size, CASE WHEN fs IS NULL THEN 0 ELSE 64 // w END AS patches, round((e[1] - list_avg(e)) / (list_stddev_samp(e) + 1e-8), 5) AS first FROM em")
def j1_stream_decode(spark, d):
    out = stream.available(stream.decoded(embedding_stream(spark, d), [8, 16, 32]), io.workspace(spark, "stream"))
    return out.select("vec_id", "window_size", F.size("patch_timestamps_us").alias("patches"), F.round(F.col("signal")[0], 5).alias("first"))


@query(f"WITH {EMB} SELECT vec_id, i::INT AS chunk_index, 3 AS num_chunks, round(list_sum(e[i * 24 + 1 : (i + 1) * 24]), 5) AS total FROM em, (SELECT unnest(range(3)) AS i)")
def j2_stream_chunks(spark, d):
    out = stream.available(stream.chunked(embedding_stream(spark, d), 8, 3), io.workspace(spark, "stream"))
    return out.select("vec_id", "chunk_index", "num_chunks", F.round(A.total(F.col("signal")), 5).alias("total"))


@query("SELECT label, count(*) FILTER (vec_id % 9 <> 0) AS kept, count(*) FILTER (vec_id % 9 = 0) AS discarded FROM embeddings GROUP BY label")
def j3_stream_counts(spark, d):
    rows = embedding_stream(spark, d).withColumn("signal", F.when(F.col("vec_id") % 9 == 0, F.transform("signal", lambda v: F.lit(1.0).cast("float"))).otherwise(F.col("signal")))
    return stream.available(stream.running_counts(rows, "label"), io.workspace(spark, "stream"), "complete")


@query("SELECT label, target, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM (SELECT label, 'vec_id' AS target, vec_id::DOUBLE AS v FROM embeddings UNION ALL SELECT label, 'part', vec_id % 11 FROM embeddings) GROUP BY ALL")
def j3_stream_label_statistics(spark, d):
    rows = embedding_stream(spark, d).withColumn("part", F.col("vec_id") % 11)
    out = stream.available(stream.label_statistics(rows, "label", "vec_id", "part"), io.workspace(spark, "stream"), "complete")
    return out.select("label", "target", "n", r6("mean", "mean"), r6("std", "std"), "min", "max")


@query("SELECT label, 1 AS n FROM embeddings GROUP BY label")
def j4_stream_first(spark, d):
    """One record a source; which one depends on the order of arrival."""
    out = stream.available(stream.first_records(embedding_stream(spark, d), "label"), io.workspace(spark, "stream"))
    return out.join(table(spark, d, "embeddings").select("vec_id", "label"), ["vec_id", "label"]).groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT vec_id, label FROM embeddings")
def j5_stream_append(spark, d):
    """The sink alone: every record once, in files of its batches."""
    return stream.available(embedding_stream(spark, d).select("vec_id", "label"), io.workspace(spark, "stream")).select("vec_id", "label")


@query(f"WITH {SIG} SELECT base_dataset AS grp, max(len(signal)) AS longest, row_number() OVER (ORDER BY base_dataset) AS place FROM sig GROUP BY base_dataset")
def f1_group_order(spark, d):
    from pyspark.sql import Window

    rows = X.signals(spark, d).groupBy(F.col("base_dataset").alias("grp")).agg(F.max(F.size("signal")).cast("long").alias("longest"))  # one row a group
    return rows.select("grp", "longest", F.row_number().over(Window.orderBy(*sequence.natural_key(F.col("grp")))).alias("place"))


@query("SELECT label, arg_min(vec_id, (vec_id * 7919) % 101 * 1000000 + vec_id) AS vec_id, min((vec_id * 7919) % 101) AS at FROM embeddings GROUP BY label")
def j4_stream_earliest(spark, d):
    """The earliest record of a source by its time and id, whatever order the files arrive in."""
    rows = embedding_stream(spark, d).select("vec_id", "label", (F.col("vec_id") * 7919 % 101).alias("at"))
    out = stream.available(stream.earliest_records(rows, "label", ["at", "vec_id"]), io.workspace(spark, "stream"), "update")
    # an earlier record replaces what the sink had before
    return out.groupBy("label").agg(F.min_by("vec_id", F.struct("at", "vec_id")).alias("vec_id"), F.min("at").alias("at"))


@query("SELECT vec_id, label, true AS bounded FROM embeddings")
def j5_buffered_files(spark, d):
    """Appended in files of at most 100 rows, which the batches' commits list; every record once."""
    path = io.workspace(spark, "files")
    stream.buffered_files(embedding_stream(spark, d).select("vec_id", "label"), path, f"{path}-checkpoint", 100).awaitTermination()
    files = recordfiles.committed_files(spark, path).select("file", (F.col("rows") <= 100).alias("bounded"))
    return recordfiles.committed_rows(spark, path).join(files, "file").select("vec_id", "label", "bounded")


RECORD = "rpad(c_mktsegment, 10, '.') || right(c_name, 8)"


@query(f"""WITH c AS (SELECT c_nationkey % 3 AS session, row_number() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_custkey) - 1 AS acq, {RECORD} AS body FROM customer)
  SELECT session::BIGINT AS session, acq, 2 AS channels, (list_sum([ord(x) for x in string_split(body, '')]) + 10)::DOUBLE AS first, ord(right(body, 1))::DOUBLE AS head FROM c""")
def a10_c4_record_ranges(spark, d):
    """Files of records of 20 bytes, one a session and channel, read in ranges of 4096 bytes; frames of both channels by record number."""
    body = F.concat(F.rpad("c_mktsegment", 10, "."), F.right("c_name", F.lit(8)))
    rows = table(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("session"), "c_custkey", F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.concat(F.lit("h"), b).alias("value")) for i, b in enumerate((body, F.reverse(body)))])).alias("c"))
    path = io.workspace(spark, "records")
    rows.select("session", "c.*", "c_custkey").repartition("session", "channel").sortWithinPartitions("session", "channel", "c_custkey").drop("c_custkey").write.partitionBy("session", "channel").text(path)
    records = byteranges.byte_records(spark, path, 20, 1, 4096, ".txt")
    named = records.select(*[F.regexp_extract("path", f"{k}=(\\d+)", 1).cast(t).alias(k) for k, t in (("session", "long"), ("channel", "int"))], "acq", "samples")
    return io.stacked_channels(named, [0, 1]).select("session", "acq", F.size("signal").alias("channels"), A.total(F.col("signal")[0]).alias("first"), F.col("signal")[1][0].cast("double").alias("head"))


@query("""SELECT c_custkey AS source, row, signal FROM (
  SELECT c_custkey, unnest([0, 1]) AS row, unnest([[c_custkey::DOUBLE, c_nationkey::DOUBLE], [c_nationkey::DOUBLE, NULL]]) AS signal FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, row, [ord(x)::DOUBLE for x in string_split(s[row * 4 + 2 : row * 4 + 4], '')] FROM (SELECT c_custkey, rpad(c_mktsegment, 12, '.') AS s, unnest([0, 1, 2]) AS row FROM customer WHERE c_custkey % 3 = 1)
  UNION ALL SELECT c_custkey, unnest([0, 1]), unnest([[c_nationkey::DOUBLE, c_custkey % 7], [NULL, c_custkey::DOUBLE]]) FROM customer WHERE c_custkey % 3 = 2)""")
def l1_registered_readers(spark, d):
    """Sources of three formats, read through one table function by what a configuration table says."""
    registry.register(spark)
    c = table(spark, d, "customer").withColumn("kind_id", F.col("c_custkey") % 3)
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.when(F.col("kind_id") == 0, F.concat(F.lit("head [0]\nx ["), key, F.lit(", "), nation, F.lit("]\n\ny ["), nation, F.lit(",]")))
    text = text.when(F.col("kind_id") == 1, F.rpad("c_mktsegment", 12, ".")).otherwise(F.concat(nation, F.lit(",,\n"), (F.col("c_custkey") % 7).cast("string"), F.lit(","), key, F.lit(",\n")))
    spark.createDataFrame([(0, "bracketed", '{"header": 1}'), (1, "bytes", '{"record_bytes": 4, "header": 1}'), (2, "columns", "{}")], "kind_id long, kind string, options string").createOrReplaceTempView("reader_settings")
    c.select(F.col("c_custkey").alias("source"), F.col("kind_id").cast("long").alias("kind_id"), F.to_binary(text, F.lit("utf-8")).alias("content")).createOrReplaceTempView("reader_records")
    return spark.sql("SELECT source, r.row, r.signal FROM reader_records JOIN reader_settings USING (kind_id), LATERAL read_record(kind, content, options) r")


# ---- models with a closed form


@query("""WITH x AS (SELECT vec_id, label::DOUBLE AS a, (vec_id % 7)::DOUBLE AS b, embedding[1]::DOUBLE AS v FROM embeddings), m AS (SELECT regr_slope(a, v) AS sa, regr_intercept(a, v) AS ia, regr_slope(b, v) AS sb, regr_intercept(b, v) AS ib FROM x)
  SELECT vec_id, round(sa * v + ia, 5) + 0.0 AS output_0, round(sb * v + ib, 5) + 0.0 AS output_1 FROM x, m""")
def k2_regression_lines(spark, d):
    """Regression heads over one feature, whose least squares SQL knows."""
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("other"), F.array(F.col("embedding")[0].cast("double")).alias("x"))
    for i, m in enumerate(evaluate.regression_heads(e, ["label", "other"], "x")):
        e = e.withColumn(f"output_{i}", F.round(A.dot(F.col("x"), F.array(*[F.lit(float(v)) for v in m.coefficients])) + float(m.intercept), 5) + 0.0)
    return e.select("vec_id", "output_0", "output_1")


@query("""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) / 2 AS angle FROM x)
  SELECT vec_id, round(abs(a * cos(angle) + b * sin(angle)), 5) AS first, round(abs(b * cos(angle) - a * sin(angle)), 5) AS second FROM x, m""")
def k4_principal_axes(spark, d):
    """The overview of two features, whose principal axes are an angle; signs of axes are free."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("x"))
    out = evaluate.overview(e, "x")
    return out.select("vec_id", *[F.round(F.abs(F.col("projection")[i]), 5).alias(n) for i, n in enumerate(("first", "second"))])


@query("SELECT o::INT AS output, j::INT AS j, 0.0::DOUBLE AS slope FROM (SELECT unnest(range(2)) AS o), (SELECT unnest(range(65)) AS j)")
def k2_all_heads(spark, d):
    """Two outputs fitted to all dimensions in one pass; the residuals of least squares are orthogonal to each of them."""
    e = table(spark, d, "embeddings").select("embedding", F.col("label").cast("double").alias("label"), (F.col("vec_id") % 7).cast("double").alias("other"))
    weights, biases = heads.regression(e, ["label", "other"], "embedding")
    left = F.zip_with(F.array("label", "other"), heads.scores(F.col("embedding").cast("array<double>"), weights, biases), lambda y, z: y - z)
    missed = scan.stored(e.select("embedding", left.alias("left")), "residuals")
    return heads.residual_slopes(missed, "embedding", F.col("left"), 2).withColumn("slope", F.round("slope", 4) + 0.0)


@query("""SELECT (dense_rank() OVER (ORDER BY label) - 1)::INT AS output, j::INT AS j, 0.0::DOUBLE AS slope FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(65)) AS j)""")
def k1_probe_slopes(spark, d):
    """Multinomial logistic regression on all dimensions: at its end the slope of the loss and of the ridge together is 0 for each class and dimension."""
    e = table(spark, d, "embeddings").select("embedding", "label")
    classes, weights, biases = heads.probe(e, "label", "embedding", 1e-3)
    n, both = e.count(), np.column_stack([biases, weights])
    told = F.transform(F.array(*map(F.lit, classes)), lambda c: (c == F.col("label")).cast("double"))
    # stored, so that scores and residuals are computed once a row and not once an output
    scored = scan.stored(e.withColumn("z", heads.scores(F.col("embedding").cast("array<double>"), weights, biases)), "scores")
    missed = scan.stored(scored.select("embedding", F.zip_with(heads.probabilities(F.col("z")), told, lambda p, y: p - y).alias("left")), "residuals")
    slopes = heads.residual_slopes(missed, "embedding", F.col("left"), len(classes))
    held = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in both])
    return slopes.select("output", "j", (F.round(F.col("slope") / n + 1e-3 * F.get(F.get(held, F.col("output")), F.col("j")), 7) + 0.0).alias("slope"))


@query("SELECT i::INT AS i, j::INT AS j, (i = j)::INT::DOUBLE AS product, true AS in_order FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)")
def k4_neighbour_layout(spark, d):
    """A layout of the embeddings' neighbour graph: its coordinates are orthogonal to each other and to the constant direction, of length 1, and come by what a step keeps of them."""
    nodes = layout.spectral_layout(layout.neighbour_graph(table(spark, d, "embeddings"), "vec_id", "embedding"))
    root = F.sqrt("degree") / F.sqrt(F.lit(nodes.agg(F.sum("degree")).first()[0] or 1.0))
    rows = nodes.select(F.array(root, F.col("y")[0], F.col("y")[1]).alias("v"), (F.col("quotients")[0] >= F.col("quotients")[1]).alias("in_order"))
    sums = rows.agg(*[F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}{j}") for i in range(3) for j in range(3)], F.bool_and("in_order").alias("in_order"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.round(f"p{i}{j}", 5) + 0.0).alias("product")) for i in range(3) for j in range(3)])
    return sums.select(F.explode(cells).alias("c"), "in_order").select("c.*", "in_order")
