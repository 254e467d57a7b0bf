"""Traps and properties of the signal operators on small hand-written rows."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import arrays as A
from wavequarry.functions import filters
from wavequarry.functions.rank import exact_rank, seeded_key
from wavequarry.operators import clean, evaluate, experiments, sampling, sequence, signal
from wavequarry.sources import io
from wavequarry.streaming import stream

NAN, INF = float("nan"), float("inf")


def one(spark, expr, values, kind="array<double>"):
    return spark.createDataFrame([(values,)], f"a {kind}").select(expr(F.col("a"))).first()[0]


def test_sanitize_then_dead(spark):
    assert one(spark, A.sanitized, [NAN, 1.0, INF, -INF]) == [0.0, 1.0, 0.0, 0.0]
    assert [one(spark, A.dead, x) for x in ([], [2.0, 2.0], [NAN, 1.0], [1e-5, -1e-5], [1.0, 2.0])] == [True, True, True, True, False]
    assert [one(spark, A.valid, x) for x in ([], [NAN], [1.0])] == [False, False, True]


def test_statistics(spark):
    assert one(spark, A.mean, []) == 0 and one(spark, A.std, []) == 0
    assert one(spark, A.std, [1.0, 3.0]) == 1 and one(spark, lambda a: A.std(a, 1), [1.0, 3.0]) == pytest.approx(math.sqrt(2))


def test_normalize(spark):
    z = one(spark, lambda a: A.normalized(a, F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), "zscore"), [2.0])
    assert z == [pytest.approx(1e8)]  # divides by s + eps, not by max(s, eps)
    assert one(spark, lambda a: A.self_normalized(a, "minmax"), [0.0, 5.0, 10.0]) == pytest.approx([-1, 0, 1], abs=1e-6)


def test_truncate_and_resample(spark):
    assert [one(spark, lambda a, m=m: A.truncated(a, 3, m), [1.0, 2.0, 3.0, 4.0, 5.0]) for m in ("left", "right", "center")] == [[1, 2, 3], [3, 4, 5], [2, 3, 4]]
    assert one(spark, lambda a: A.truncated(a, 3), [1.0]) == [1.0]
    assert one(spark, lambda a: A.resampled(a, 7), [0.0, 1.0, 4.0, 9.0]) == pytest.approx(np.interp(np.linspace(0, 3, 7), range(4), [0, 1, 4, 9]).tolist())
    assert one(spark, lambda a: A.resampled(a, 3), []) == [0, 0, 0] and one(spark, lambda a: A.resampled(a, 3), [2.0]) == [2, 2, 2]
    assert one(spark, lambda a: A.interpolated(a, 2, force=True), [0.0, 1.0, 4.0]) == [0, 4]
    with pytest.raises(ValueError):
        A.resampled(F.col("a"), 0)


def test_routing_of_a_missing_rate(spark):
    rows = spark.createDataFrame([(8e6,), (20e6,), (40.96e6,), (None,)], "fs double")
    assert [r[0] for r in rows.select(A.routed(F.col("fs"), [16, 8, 32])).collect()] == [8, 16, 32, 16]
    assert rows.where("fs is null").select(A.routed(F.col("fs"), [16, 8, 32], "smallest")).first()[0] == 8


def test_chunks_count_before_dropping(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(17)]), ("b", [1.0])], "id string, signal array<double>")
    rows = signal.chunks(df, "signal", F.lit(4), 2, 1).orderBy("chunk_index").collect()
    assert [(r["id"], r["chunk_index"], r["num_chunks"], len(r["signal"])) for r in rows] == [("a", 0, 3, 8), ("a", 1, 3, 8)]
    whole = signal.chunks(df.where("id = 'a'"), "signal", F.lit(1), 8, 1)
    assert signal.stitched(whole, "id", "signal").first()["signal"] == [float(i) for i in range(17)]
    assert signal.stitched(whole.where("chunk_index <> 1"), "id", "signal").count() == 0


def test_midpoints_and_patches(spark):
    df = spark.createDataFrame([(3, 4, 1e6), (3, 4, None)], "n int, w int, fs double")
    assert [r[0] for r in df.select(A.midpoints_us(F.col("n"), F.col("w"), F.col("fs"), 4)).collect()] == [[6, 10, 14], []]
    assert one(spark, lambda a: A.patches(a, 2), [1.0, 2.0, 3.0]) == [[1, 2]] and one(spark, lambda a: A.patches(a, 2), []) == []


def test_band_edges_fall_back_twice(spark):
    rows = spark.createDataFrame([(5e6, 20e6), (4.02e6, 8e6), (9e6, 8e6)], "fc double, fs double")
    got = [tuple(r) for r in rows.select(*A.band_edges(F.col("fc"), F.col("fs"), 0.01)).collect()]
    assert got == [pytest.approx(x) for x in ((4.975e6, 5.025e6), (3.98e6, 3.996e6), (1.998e6, 3.996e6))]


def test_midpoints_of_resampled_signals(spark):
    df = spark.createDataFrame([(39, 20, 1e6)], "raw int, n int, fs double")
    scale = A.resampling(F.col("raw"), F.col("n"))
    assert df.select(A.midpoints_us(F.lit(2), F.lit(4), F.col("fs"), 7, scale)).first()[0] == [4.0, 12.0]


def test_reconstruction_of_constants_is_not_a_number(spark):
    df = spark.createDataFrame([("c", 0.1, float(i)) for i in range(50)] + [("v", float(i), 2.0 * i) for i in range(50)], "base string, t double, p double")
    got = {r["base"]: r for r in evaluate.recon_metrics(evaluate.recon_sums(df, "t", "p", "base")).collect()}
    assert math.isnan(got["c"]["r"]) and got["v"]["r"] == pytest.approx(1) and not math.isnan(got["v"]["r2"])
    patches = spark.createDataFrame([([1.0, 3.0], [0.0, 1.0])], "t array<double>, p array<double>")
    sums = evaluate.patch_sums(patches, "t", "p", normalize=True).first()
    assert sums["n"] == 2 and sums["st"] == pytest.approx(0) and sums["stt"] == pytest.approx(1)


def test_element_sums_are_the_plain_ones(spark):
    rng = np.random.default_rng(41)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i % 4, v.tolist()) for i, v in enumerate(x)] + [(0, None)], "label int, x array<double>").repartition(3)
    got = {r["class"]: r["centroid"] for r in evaluate.centroids(df, "label", "x").collect()}
    assert all(np.allclose(got[k], x[k::4].mean(0)) for k in range(4))
    frames = spark.createDataFrame([([[1.0, 2.0], [3.0, 5.0]],), ([[7.0], []],)], "signal array<array<double>>")
    stats = {r["channel"]: r for r in signal.channel_stats(frames, "signal").collect()}
    assert stats[0]["mean"] == pytest.approx(10 / 3) and stats[0]["std"] == pytest.approx(np.std([1, 2, 7])) and stats[1]["std"] == pytest.approx(1)


def test_offsets_of_keys_with_a_common_prefix(spark):
    df = spark.createDataFrame([(f"dataset/{i:05d}", [0.0] * (i % 7)) for i in range(3000)], "k string, signal array<double>").repartition(5)
    got = io.offsets(df, "k", "signal")
    rows, at = got.orderBy("k").collect(), 0
    for r in rows:
        assert (r["start"], r["stop"]) == (at, at + r["length"])
        at = r["stop"]
    assert io.offsets(df.limit(0), "k", "signal").count() == 0


def test_fourier_resampling_keeps_tones(spark):
    t = np.arange(32) / 32
    df = spark.createDataFrame([(np.cos(2 * np.pi * 3 * t).tolist(),)], "x array<double>")
    for n in (48, 20):
        got = df.select(signal.fourier_resampled(F.col("x"), n)).first()[0]
        assert np.allclose(got, np.cos(2 * np.pi * 3 * np.arange(n) / n))


def test_registries(spark, tmp_path):
    t = spark.createDataFrame([(1, p, True, [float(p)]) for p in range(4)], "owner_id int, pos int, valid boolean, vec array<double>")
    assert evaluate.pooled(t, "mean").first()["v"] == 1.5 and evaluate.pooled(t, "bins", bins=2).count() == 2 and evaluate.pooled(t, "flatten").first()["vector"] == [0, 1, 2, 3]
    assert io.read_as("wide", spark.createDataFrame([(1, [1.0], [2.0])], "i int, a array<double>, b array<double>"), columns=["a", "b"]).count() == 2
    (tmp_path / "group_3" / "run_4").mkdir(parents=True)
    (tmp_path / "group_3" / "run_4" / "config.yaml").write_text("model:\n  lr: 0.5\n  names: [a, b]\n")
    pytest.importorskip("yaml")
    c = io.run_configs(spark, str(tmp_path), "*.yaml")
    assert [tuple(r) for r in c.select("grp", "run", io.dig(F.col("config"), "model.lr"), io.dig(F.col("config"), "model.names[1]")).collect()] == [("group_3", "run_4", "0.5", "b")]


def test_listed_files_tell_what_is_missing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    got = io.listed(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"]).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["found"], r["length"]) for r in got] == [("a.txt", True, 1), ("b.txt", False, None)]


def test_configurations(spark):
    rows = spark.createDataFrame([(1, 64, 16, 0.8, 0.1, 0.1, 5e6, None, None, None, None), (2, 64, 10, 0.8, 0.1, 0.2, None, 2.0, 0, "top", "side")], "k int, samples_per_shard int, batch_size int, train double, val double, test double, tx_fc_hz double, rf_bandwidth_fraction double, truncate_signal_length int, truncate_signal_mode string, interpolation_truncate_mode string")
    got = clean.violations(rows, clean.config_rules(True)).collect()
    assert {(r["k"], r["rule"]) for r in got} == {(2, x) for x in ("shard", "ratios", "bandwidth", "length", "mode", "interpolation", "centre")}


def test_filters_by_their_definition():
    """Coefficients by the frequency response, passes by dense matrices, end states by least squares over both orders."""
    rng = np.random.default_rng(42)
    w = np.linspace(0.01, 0.99, 50)
    for kind in ("low", "high", "band", "stop"):
        b, a = filters.butterworth_coefficients(3, 0.2, 0.5, kind)
        z = np.exp(-1j * np.pi * np.outer(w, np.arange(len(a))))
        t, lo, hi = np.tan(np.pi * w / 2), np.tan(np.pi * 0.1), np.tan(np.pi * 0.25)
        s = {"low": t / hi, "high": lo / t, "band": (t * t - lo * hi) / (t * (hi - lo)), "stop": t * (hi - lo) / (t * t - lo * hi)}[kind]
        assert np.allclose(np.abs(z @ b / (z @ a)) ** 2, 1 / (1 + s**6))
    b, a = filters.butterworth_coefficients(2, 0.2, 0.5, "band")
    n, m, x = 40, len(a) - 1, rng.normal(size=(3, 40))
    h = filters.filtered(b, a, np.eye(n), np.zeros((n, m))).T  # column i: the answer to an impulse at i
    o, r = filters.filtered(b, a, np.zeros((m, n)), np.eye(m)).T, np.eye(n)[::-1]
    x = [*x, rng.normal(size=40)]
    got = filters.forward_backward(b, a, [*x, rng.normal(size=33)])
    for row, y in zip(x, got):
        fb, bf = r @ h @ r @ h @ row, h @ r @ h @ r @ row
        cost = np.hstack([r @ h @ r @ o - o, r @ o - h @ r @ o])
        states = np.linalg.lstsq(cost, bf - fb, rcond=None)[0]
        assert np.allclose(y, fb + np.hstack([r @ h @ r @ o, r @ o]) @ states)
    low = filters.butterworth_coefficients(3, 0.2, 0.3, "low")
    assert np.allclose(filters.padded_forward_backward(*low, [np.full(60, 2.5)]), 2.5)
    with pytest.raises(ValueError):
        filters.padded_forward_backward(*low, [np.ones(5)])


def test_butterworth_kinds(spark):
    t = np.arange(600) / 1e3
    df = spark.createDataFrame([(f, np.sin(2 * np.pi * f * t).tolist(), 1e3) for f in (20, 100, 400)], "f int, x array<double>, fs double")
    passes = {"low": {20}, "high": {400}, "band": {100}, "stop": {20, 400}}
    for kind, kept in passes.items():
        low, high = {"low": (1.0, 50.0), "high": (200.0, 400.0)}.get(kind, (50.0, 200.0))
        for r in df.select("f", "x", signal.butterworth(F.col("x"), F.col("fs"), F.lit(low), F.lit(high), kind).alias("y")).collect():
            x, y = (np.array(v)[200:400] for v in (r["x"], r["y"]))
            assert np.abs(y - x).max() < 0.1 if r["f"] in kept else np.abs(y).max() < 0.1


def test_blocks_equal_single_steps():
    """The recurrence in blocks gives what it gives sample by sample, for signals of many lengths at once."""
    rng = np.random.default_rng(3)
    for order, kind in ((4, "band"), (2, "low"), (3, "stop")):
        b, a = filters.butterworth_coefficients(order, 0.1, 0.4, kind)
        x, state = rng.normal(size=(4, 331)), rng.normal(size=(4, len(a) - 1))
        assert np.allclose(filters.filtered(b, a, x, state), filters.stepped(b, a, x, state)[0])
        signals = [rng.normal(size=n) for n in (60, 64, 65, 500, 61, 1000, 60, 131)]
        for passes in (filters.forward_backward, filters.padded_forward_backward):
            for one, y in zip(signals, passes(b, a, signals)):
                assert len(y) == len(one) and np.allclose(y, passes(b, a, [one])[0])


def test_spectral_filters(spark):
    t = np.arange(512) / 1e3
    tones = {f: np.sin(2 * np.pi * f * t).tolist() for f in (100, 400)}
    df = spark.createDataFrame([(f, x, 1e3) for f, x in tones.items()] + [(0, [1.0, 2.0], 1e3), (1, tones[400], None)], "f int, x array<double>, fs double")
    out = {r["f"]: np.array(r["y"]) for r in df.select("f", signal.bandpass(F.col("x"), F.col("fs"), F.lit(50.0), F.lit(150.0)).alias("y")).collect()}
    mid = slice(128, 384)
    assert np.abs(out[100][mid] - np.array(tones[100])[mid]).max() < 0.05 and np.abs(out[400][mid]).max() < 0.01
    assert out[0].tolist() == [1, 2] and out[1].tolist() == tones[400]
    e = np.array(df.where("f = 100").select(signal.envelope(F.col("x"))).first()[0])
    assert np.abs(e[mid] - 1).max() < 0.1
    assert len(df.where("f = 100").select(signal.fourier_resampled(F.col("x"), 100)).first()[0]) == 100


def test_allocation_sums_up(spark):
    rng = np.random.default_rng(40)
    ratios = {"train": 0.8, "val": 0.1, "test": 0.1}
    rows = spark.createDataFrame([(int(n),) for n in rng.integers(0, 10_000, 60)], "n long")
    sizes = sampling.allocation(F.col("n"), ratios)
    for r in rows.select("n", *[v.alias(k) for k, v in sizes.items()]).collect():
        assert sum(r[k] for k in ratios) == r["n"] and all(0 <= r[k] - math.floor(r["n"] * v + 1e-9) <= 1 for k, v in ratios.items())


def test_allocation_ties(spark):
    def sizes(n, ratios, ties):
        return spark.range(1).select(*[v.alias(k) for k, v in sampling.allocation(F.lit(n), ratios, ties).items()]).first().asDict()

    thirds = {"train": 0.5, "val": 0.25, "test": 0.25}
    # 2.5, 1.25, 1.25: one row is left for the greatest fraction; of 1.5, 0.75, 0.75 two for the greater ones
    assert sizes(5, thirds, "name") == {"train": 3, "val": 1, "test": 1} and sizes(3, thirds, "name") == {"train": 1, "val": 1, "test": 1}
    even = {"train": 0.5, "val": 0.5}
    assert sizes(1, even, "name") == {"train": 0, "val": 1} and sizes(1, even, "order") == {"train": 1, "val": 0}


def test_split_partitions_the_input(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 900, "a").otherwise("b").alias("s"))
    a = sampling.stratified_split(df, "s", "k").collect()
    assert len(a) == 1000 and sorted(r["k"] for r in a) == sorted(str(i) for i in range(1000))
    assert sum(r["split"] == "train" for r in a if r["s"] == "b") == 80
    assert sorted(map(str, a)) == sorted(map(str, sampling.stratified_split(df.repartition(3), "s", "k").collect()))


def test_exact_rank_is_the_sorted_place(spark):
    df = spark.range(500).select(F.lit(0).alias("p"), F.col("id")).withColumn("k", seeded_key(1, "x", "id"))
    rows = exact_rank(df, ["p"], "k", ["id"]).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == [r["id"] for r in sorted(rows, key=lambda r: r["k"])]


def test_shards_wrap_or_drop(spark):
    df = spark.range(10)
    assert sampling.sharded(df, "id", 4, 1).count() == 8 and sampling.sharded(df, "id", 4, 1, drop_last=False).count() == 12
    assert sampling.proportional_cap(101, 0.3) == 30


def test_splits_that_cannot_be(spark):
    df = spark.range(3).withColumn("g", F.lit(1))
    with pytest.raises(ValueError):
        sampling.random_split(df, "id", 0.1, 0.1)
    with pytest.raises(ValueError):
        sampling.leave_one_out(df, "g", 1)
    with pytest.raises(ValueError):
        sampling.leave_one_out(df, "g", 1, 1)


def test_transitions_after_leading_invalid_rows(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["?", "?", "a", "a", "?", "a", "b", "b"])], "t int, label string").withColumn("g", F.lit(0))
    c = sequence.transitions(df, ["g"], ["t"], "label", F.col("label") == "?")
    assert [r["changed"] for r in c.orderBy("t").collect()] == [False, False, True, False, False, False, True, False]
    assert [r["t"] for r in sequence.cut_transients(c, ["g"], 2).orderBy("t").collect()] == [0, 1, 4, 5]
    assert sequence.cut_length(0, 100) == 1 and sequence.cut_length(25, 100) == 2


def test_invalid_label_takes_the_row(spark):
    df = spark.createDataFrame([(clean.INVALID[0], "x", 7), (1, "y", 8)], "label long, name string, s int")
    assert [tuple(r) for r in clean.invalidate(df, "label", ["name", "s"]).collect()] == [(-1, "-1", -1), (1, "y", 8)]


def test_folds_and_last_epochs(spark):
    ids = spark.createDataFrame([(1,), (4,), (9,)], "g int")
    assert [tuple(r) for r in sequence.fold_rotation(ids, "g").orderBy("test").collect()] == [(1, 4), (4, 9), (9, 1)]
    assert sequence.fold_rotation(ids.where("g = 1"), "g").count() == 0
    logs = spark.createDataFrame([("r", 0, 1.0, 0.1), ("r", 1, 3.0, None), ("r", 2, None, 0.7), ("r", 3, 2.0, 0.2)], "run string, line int, epoch double, acc double")
    assert experiments.last_epoch(logs, ["run"], "epoch", "line", "acc").first()["acc"] == 0.2


def test_bins_of_one_are_the_mean(spark):
    t = spark.createDataFrame([(1, 0, True, [1.0, 2.0]), (1, 1, False, [9.0, 9.0]), (1, 2, True, [3.0, 4.0]), (2, 0, False, [5.0, 5.0])], "owner_id int, pos int, valid boolean, vec array<double>")
    rows = {(r["owner_id"], r["dim"]): r["v"] for r in evaluate.pool(t, "mean", 1).collect()}
    assert rows == {(1, 0): 2.0, (1, 1): 3.0, (2, 0): 0.0, (2, 1): 0.0}
    assert {r["owner_id"]: r["vector"] for r in evaluate.pool(t, "flat", tokens_kept=2).collect()} == {1: [1, 2, 0, 0], 2: [0, 0, 0, 0]}


def test_scores_without_a_divisor(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1)], "t int, p int")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "class int")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.class_scores(evaluate.confusion(rows, "t", "p", classes)).collect()}
    assert got[1] == (0, 0, 0) and got[2] == (0, 0, 0) and got[0][:2] == (1.0, 0.5)


def test_losses(spark):
    p = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0], True)], "p array<double>, t array<double>, m boolean")
    assert evaluate.patch_losses(p, "p", "t", "l2").first()["loss"] == 2 and evaluate.patch_losses(p, "p", "t", "l2", divisor=4).first()["loss"] == 1
    assert evaluate.patch_losses(p, "p", "t", "smooth_l1").first()["loss"] == 0.75


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h\nx [1, 2] y]\n\n[3,4]\n")
    rows = io.bracketed_text(io.text_lines(spark, str(tmp_path / "a.txt")), 1).orderBy("row").collect()
    assert [(r["row"], r["signal"][0]) for r in rows] == [(0, 1.0), (1, 3.0)]
    assert io.discover(spark, str(tmp_path), "*.txt").count() == 1
    files = spark.createDataFrame([(1, 0, bytes([0, 1, 2, 0, 3, 4])), (1, 1, bytes([9, 5, 6, 9, 7, 8])), (2, 0, bytes([0, 1, 2]))], "session int, channel int, content binary")
    frames = io.stacked_channels(io.byte_records(files, 3, 1), [0, 1]).orderBy("acq").collect()
    assert [(r["session"], r["acq"], r["signal"]) for r in frames] == [(1, 0, [[1, 2], [5, 6]]), (1, 1, [[3, 4], [7, 8]])]
    with pytest.raises(Exception, match="multiple"):
        io.byte_records(files, 4, 1).collect()
    csv = spark.createDataFrame([(0, 1.0, None), (1, 2.0, None)], "i int, a double, b double")
    assert [tuple(r) for r in io.trace_columns(csv, "i").collect()] == [("a", [1.0, 2.0])]
    paths = spark.createDataFrame([("/x/grip_session1.h5",), ("/x/grip_session2_1.h5",), ("/x/pose_session1.h5",)], "path string")
    assert io.session_files(paths, "grip", ["session2_1"]).count() == 1
    rows = spark.createDataFrame([("raw", "train", 1)], "format string, split string, x int")
    io.write_tree(rows, str(tmp_path / "out"))
    assert io.read_corpus(spark, str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        io.read_corpus(spark, str(tmp_path / "out"), need_stats=True)
    with pytest.raises(Exception, match="another shape"):
        io.checked_frames(spark.createDataFrame([([[1.0]],)], "signal array<array<double>>"), 2, 1, None).collect()
    log = tmp_path / "g" / "group_1" / "run_2"
    log.mkdir(parents=True)
    (log / "m.csv").write_text("epoch,acc\n1,0.5\n")
    got = io.metric_logs(spark, str(tmp_path / "g")).first()
    assert (got["grp"], got["run"], got["acc"]) == ("group_1", "run_2", "0.5")


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"s{i % 3}", 8e6, [float(j + i) for j in range(20)] if i % 4 else []) for i in range(24)], "sample_id string, source string, sampling_frequency_hz double, signal array<double>")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: stream.source(spark, str(tmp_path / "in"), rows.schema, 1)

    def ran(df, mode):
        name = f"q{abs(hash(str(df.columns) + mode)) % 10**8}"
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(str, spark.table(name).collect()))

    batch = lambda df: sorted(map(str, df.collect()))
    assert ran(stream.decoded(source(), [8, 16]), "append") == batch(stream.decoded(rows, [8, 16]))
    assert ran(stream.chunked(source(), 2, 4), "append") == batch(stream.chunked(rows, 2, 4))
    assert ran(stream.running_counts(source(), "source"), "complete") == batch(stream.running_counts(rows, "source"))
    assert len(ran(stream.first_records(source(), "source"), "append")) == 3
    q = source().writeStream.foreachBatch(stream.append_once(str(tmp_path / "sink"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 24
    assert stream.estimated_batches(10, 100, 2, 4, 10) == 48 and stream.estimated_batches(1, 1, 8, 4, 512) == 1 and stream.estimated_batches(0, 9, 1, 4, 2) == 1 and stream.estimated_batches(3, 64, 1, 8, 16) == 12


def test_discriminant_axes(spark):
    rng = np.random.default_rng(30)
    x = rng.normal(size=(240, 64))
    x[:, 50] += 9.0 * (np.arange(240) % 3)
    x[:, 60] += 9.0 * (np.arange(240) % 3 == 1)
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "label int, x array<double>").repartition(4)
    sums = evaluate.scatter(df, "label", "x")
    got = np.zeros((3, 64, 64))
    for r in sums.collect():
        got[r["group"], r["i"], r["j"]] = r["sab"]
    assert np.allclose(got, [x[g::3].T @ x[g::3] for g in range(3)])
    axes = evaluate.discriminant_axes(sums, 64)
    y = x @ axes.T
    means = np.array([y[g::3].mean(0) for g in range(3)])
    assert axes.shape == (2, 64) and all(np.argmin(((means - v) ** 2).sum(1)) == i % 3 for i, v in enumerate(y))


def test_statistics_are_computed_once_a_signal(spark):
    """By their cost: an expression that a lambda names again is evaluated for each element, and those of a thousand samples would take minutes."""
    x = np.random.default_rng(3).normal(size=1000)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    began = time.time()
    got = df.select(*[f.alias(n) for n, f in {"z": A.self_normalized(F.col("x"), "zscore"), "u": A.self_normalized(F.col("x"), "minmax"), "p": A.unit_patch(F.col("x")), "s": A.std(F.col("x"), 1)}.items()]).first()
    assert time.time() - began < 20
    assert np.allclose(got["z"], (x - x.mean()) / (x.std(ddof=1) + 1e-8)) and np.allclose(got["p"], (x - x.mean()) / x.std(ddof=1))
    assert np.allclose(got["u"], 2 * (x - x.min()) / (x.max() - x.min() + 1e-8) - 1) and got["s"] == pytest.approx(x.std(ddof=1))
    empty = spark.createDataFrame([([], None), ([5.0], None)], "x array<double>, n array<double>").select(A.self_normalized(F.col("x"), "zscore").alias("z"), A.self_normalized(F.col("n"), "zscore").alias("n")).collect()
    assert [tuple(r) for r in empty] == [([], None), ([0.0], None)]


def test_formats_take_one_python_worker_a_task(spark):
    """Band-pass and envelope are one Python function, with the values of both, with and without a rate."""
    rows = [(1, [float((7 * i) % 11) for i in range(40)], 100.0, 20.0), (2, [1.0, 2.0, 4.0], None, 20.0), (3, [1.0, 3.0], 100.0, None), (4, [], 100.0, 20.0)]
    df = spark.createDataFrame(rows, "k int, x array<double>, fs_hz double, fc_hz double")
    made = signal.formats(df, "x", 8, 2)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r["k"], r["format"]): r["x"] for r in made.collect()}
    low, high = A.band_edges(F.lit(20.0), F.lit(100.0), 0.6)
    band = df.where("k = 1").select(signal.bandpass(F.col("x"), F.lit(100.0), low, high, 2).alias("b")).select("b", signal.envelope(F.col("b")).alias("e")).first()
    assert got[1, "bandpass"] == band["b"] != rows[0][1] and got[1, "envelope"] == band["e"]
    for k, x, *_ in rows[1:]:
        assert got[k, "bandpass"] == got[k, "raw"] == x and len(got[k, "envelope"]) == len(x)
