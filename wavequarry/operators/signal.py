"""Signals to chunks, patches and normalised frames; spectral filters where built-in functions can't express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavequarry.functions import arrays as A
from wavequarry.functions import filters


def chunks(df: DataFrame, signal: str, patch: Column, per_chunk: int, min_patches: int = 1) -> DataFrame:
    """Slices of per_chunk patches. num_chunks counts them before short ones are dropped; signals below the least length go."""
    size, width = F.size(signal), patch * per_chunk
    n = F.greatest(F.lit(1), F.ceil(size / width)).cast("int")
    out = df.withColumn("_w", patch).where(F.size(signal) >= F.col("_w") * min_patches).withColumn("num_chunks", n).withColumn("full_length", size)
    out = out.withColumn("chunk_index", F.explode(A.indices(F.col("num_chunks")))).withColumn("chunk_start", F.col("chunk_index") * width)
    out = out.withColumn(signal, F.slice(signal, F.col("chunk_start") + 1, width)).withColumn("window_size", F.col("_w").cast("int"))
    return out.where(F.floor(F.size(signal) / F.col("_w")) >= min_patches).drop("_w")


def stitched(chunk_rows: DataFrame, key: str, signal: str) -> DataFrame:
    """Chunks joined again; only acquisitions of which all chunks are there."""
    rows = chunk_rows.groupBy(key, "num_chunks").agg(F.array_sort(F.collect_list(F.struct("chunk_index", signal))).alias("c"))
    return rows.where(F.size("c") == F.col("num_chunks")).select(key, F.flatten(F.transform("c", lambda c: c[signal])).alias(signal))


def valid_patches(n: Column, width: int, per_chunk: int) -> Column:
    """Whole patches of each chunk of a signal of n samples; at least one chunk."""
    span = width * per_chunk
    chunks_ = F.greatest(F.lit(1), F.ceil(n / span)).cast("int")
    return F.transform(A.indices(chunks_), lambda i: F.floor(F.least(n - i * span, F.lit(span)) / width).cast("int"))


def truncated_formats(rows: DataFrame, signal: str, params: DataFrame, formats_cut: tuple[str, ...] = ("raw", "envelope")) -> DataFrame:
    """rows: format, base_dataset, signal. Formats that keep their length are cut to the length of their data set, where it has one."""
    out = rows.join(params.select("base_dataset", "truncate_signal_length", "truncate_signal_mode"), "base_dataset", "left")
    cut = A.truncated(F.col(signal), F.col("truncate_signal_length"), F.coalesce("truncate_signal_mode", F.lit("left")))
    return out.withColumn(signal, F.when(F.col("format").isin(*formats_cut) & F.col("truncate_signal_length").isNotNull(), cut).otherwise(F.col(signal))).drop("truncate_signal_length", "truncate_signal_mode")


def patch_rows(df: DataFrame, signal: str, width: Column | int) -> DataFrame:
    return df.select("*", F.posexplode(A.patches(F.col(signal), width)).alias("patch_index", "patch")).drop(signal)


def global_stats(signal: Column) -> list[Column]:
    return [A.mean(signal).alias("mean"), A.std(signal).alias("std"), F.coalesce(F.array_min(signal), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(signal), F.lit(0.0)).alias("max")]


def channel_rows(df: DataFrame, signal: str) -> DataFrame:
    return df.select("*", F.posexplode(signal).alias("channel", "samples")).drop(signal)


def channels_together(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda c: c["samples"])).alias("vector"))


def channel_stats(frames: DataFrame, signal: str) -> DataFrame:
    """Per channel over all samples of the given frames: mean, population std, min, max. A row a channel and frame is shuffled at most."""
    rows = channel_rows(frames, signal).select("channel", F.col("samples").cast("array<double>").alias("x")).where(F.size("x") > 0)
    each = rows.select("channel", F.size("x").alias("n"), A.mean(F.col("x")).alias("m"), A.std(F.col("x")).alias("d"), F.array_min("x").alias("low"), F.array_max("x").alias("high"))
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    # the spread of all: that within the frames and that of their means
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / n - m * m
    within = F.sum(F.col("n") * F.col("d") * F.col("d")) / n
    return each.groupBy("channel").agg(m.alias("mean"), F.sqrt(F.greatest(within + between, F.lit(0.0))).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"))


def frames_normalized(frames: DataFrame, signal: str, stats: DataFrame, key: list[str], mode: str = "zscore") -> DataFrame:
    """Each channel with its statistics. The statistics have one row per channel, which bounds the broadcast."""
    rows = channel_rows(frames, signal).join(F.broadcast(stats), "channel")
    return rows.withColumn("samples", A.normalized(F.col("samples"), F.col("mean"), F.col("std"), F.col("min"), F.col("max"), mode)).select(*key, "channel", "samples")


def padded_batches(df: DataFrame, batch: str, signal: str) -> DataFrame:
    longest = F.max(F.size(signal)).over(Window.partitionBy(batch))
    df = df.withColumn("_l", longest)
    return df.withColumn("mask", A.pad_mask(F.col(signal), F.col("_l"))).withColumn(signal, A.padded(F.col(signal), F.col("_l"))).drop("_l")


def formats(df: DataFrame, signal: str, length: int, order: int = 4) -> DataFrame:
    """One input, four outputs; the filtered ones need fs and fc (columns fs_hz, fc_hz, width), else they are unfiltered."""
    low, high = A.band_edges(F.col("fc_hz"), F.col("fs_hz"), 0.6)
    able = F.col("fs_hz").isNotNull() & F.col("fc_hz").isNotNull()
    # both in one Python function: a second one behind it would be a second worker beside each task
    df = df.withColumn("_made", band_and_envelope(F.col(signal), F.when(able, F.col("fs_hz")), low, high, order)).withColumn("_band", F.col("_made.band")).withColumn("_envelope", F.col("_made.envelope")).drop("_made")
    made = {"raw": F.col(signal), "bandpass": F.col("_band"), "envelope": F.col("_envelope"), "interpolate": A.interpolated(F.col(signal), length)}
    rows = F.array(*[F.struct(F.lit(k).alias("format"), A.sanitized(v.cast("array<double>")).alias("signal")) for k, v in made.items()])
    out = df.withColumn("_f", F.explode(rows))
    return out.withColumn("format", F.col("_f.format")).withColumn(signal, F.col("_f.signal")).drop("_f", "_band", "_envelope")


def grouped(*options: pd.Series) -> dict[tuple, list[int]]:
    """Rows with equal options, which can be filtered together."""
    groups: dict[tuple, list[int]] = {}
    for i, o in enumerate(zip(*options)):
        groups.setdefault(o, []).append(i)
    return groups


def passed(x: pd.Series, fs: pd.Series, low: pd.Series, high: pd.Series, order: int) -> pd.Series:
    """``bandpass`` of a batch."""
    out = x.tolist()
    for (rate, first, last), rows in grouped(fs, low, high).items():
        rows = [i for i in rows if out[i] is not None and len(out[i]) >= 3 * order]
        if not rows or not rate or not rate > 0:
            continue
        bottom = max(1e-6, min(2 * first / rate, 0.999))
        b, a = filters.butterworth_coefficients(order, bottom, max(bottom + 1e-6, min(2 * last / rate, 0.999)), "band")
        for i, y in zip(rows, filters.forward_backward(b, a, [np.asarray(out[i], dtype=float) for i in rows])):
            out[i] = y
    return pd.Series(out)


def bandpass(signal: Column, fs: Column, low: Column, high: Column, order: int = 4) -> Column:
    """Zero-phase band-pass with the end states for which the order of both passes matters least. Signals without a positive
    rate, or shorter than 3 orders, pass unchanged."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, fs: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return passed(x, fs, low, high, order)

    return run(signal, fs, low, high)


def band_and_envelope(signal: Column, fs: Column, low: Column, high: Column, order: int = 4) -> Column:
    """``bandpass`` and the ``envelope`` of it, as a struct."""

    @F.pandas_udf("band array<double>, envelope array<double>")
    def run(x: pd.Series, fs: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        band = passed(x, fs, low, high, order)
        return pd.DataFrame({"band": band, "envelope": by_length(band, amplitudes, [])})

    return run(signal, fs, low, high)


def butterworth(signal: Column, fs: Column, low: Column, high: Column, kind: str = "band", order: int = 4) -> Column:
    """Zero-phase filter of any kind (band, stop, low: below ``high``, high: above ``low``) over oddly extended signals, which
    need more samples than three times its coefficients."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, fs: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        out = x.tolist()
        for (rate, first, last), rows in grouped(fs, low, high).items():
            rows = [i for i in rows if out[i] is not None]
            b, a = filters.butterworth_coefficients(order, 2 * first / rate, 2 * last / rate, kind)
            for i, y in zip(rows, filters.padded_forward_backward(b, a, [np.asarray(out[i], dtype=float) for i in rows])):
                out[i] = y
        return pd.Series(out)

    return run(signal, fs, low, high)


def by_length(x: pd.Series, one: Callable[[np.ndarray], np.ndarray], empty: object) -> pd.Series:
    """``one`` over matrices of signals of equal lengths; null stays null, an empty signal gives ``empty``."""
    out, lengths = x.tolist(), pd.Series([-1 if v is None else len(v) for v in x])
    for (n,), rows in grouped(lengths).items():
        if n == 0:
            made = [empty] * len(rows)
        elif n > 0:
            made = one(np.array([out[i] for i in rows], dtype=float))
        else:
            continue
        for i, y in zip(rows, made):
            out[i] = y
    return pd.Series(out)


def amplitudes(v: np.ndarray) -> np.ndarray:
    n = v.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(v) * h))


def envelope(signal: Column) -> Column:
    """Amplitude of the analytic signal."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return by_length(x, amplitudes, [])

    return run(signal)


def fourier_resampled(signal: Column, length: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> np.ndarray:
            n, m = v.shape[1], min(v.shape[1], length)
            s = np.fft.rfft(v)[:, : m // 2 + 1]
            if m % 2 == 0 and n != length:
                s[:, -1] *= 2 if length < n else 0.5
            return np.fft.irfft(s, length) * (length / n)

        return by_length(pd.Series([[] if v is None else v for v in x]), one, [0.0] * length)

    return run(signal)


def preprocessed(df: DataFrame, signal: str, fs: Column, low: Column, high: Column, length: int | None, with_envelope: bool, order: int = 4) -> DataFrame:
    """Band-pass, then envelope, then interpolation; each is a column of its own, as lambdas can't hold Python functions."""
    df = df.withColumn(signal, bandpass(F.col(signal), fs, low, high, order))
    df = df.withColumn(signal, envelope(F.col(signal))) if with_envelope else df
    return df.withColumn(signal, A.interpolated(F.col(signal), length)) if length else df
