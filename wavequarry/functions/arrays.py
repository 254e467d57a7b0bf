"""Column expressions over signal arrays. Sums run in double precision; an empty array never reaches sequence()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED, TARGET_MM = 1_540_000.0, 0.6


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row. Spark evaluates an expression that a lambda's body names again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(a: Column, f=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v.cast("double")))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(0.0)


def std(a: Column, ddof: int = 0) -> Column:
    squares = bound(mean(a), lambda m: total(a, lambda v: (v - m) * (v - m)))
    return F.when(F.size(a) > ddof, F.sqrt(squares / (F.size(a) - ddof))).otherwise(0.0)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def sanitized(a: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(a, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))


def finite(a: Column) -> Column:
    return ~F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def dead(a: Column, min_energy: float = 1e-6) -> Column:
    """Empty, non-finite, constant, or of a mean square below ``min_energy``."""
    return F.coalesce((F.size(a) == 0) | ~finite(a) | (F.array_max(a) == F.array_min(a)) | (total(a, lambda v: v * v) / F.greatest(F.size(a), F.lit(1)) < min_energy), F.lit(True))


def valid(a: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & finite(a), F.lit(False))


def truncated(a: Column, length: int | Column, mode: str | Column = "left") -> Column:
    """Longer signals cut to ``length``; a null length passes them whole."""
    length, mode = (F.lit(v) if isinstance(v, (int, str)) else v for v in (length, mode))
    extra = F.size(a) - length
    start = F.when(mode == "right", extra).when(mode == "center", F.floor(extra / 2)).otherwise(0).cast("int")
    return F.when(extra > 0, F.slice(a, start + 1, length)).otherwise(a)


def resampled(a: Column, length: int) -> Column:
    """Linear interpolation on the grid j (n - 1) / (length - 1); an empty signal gives zeros."""
    if length <= 0:
        raise ValueError("length must be positive")
    n = F.size(a)

    def at(j: Column) -> Column:
        x = j * (n - 1) / F.lit(float(max(1, length - 1)))
        low = F.least(F.floor(x).cast("int"), n - 1)
        first, second = F.get(a, low).cast("double"), F.get(a, F.least(low + 1, n - 1)).cast("double")
        return first + (second - first) * (x - low)

    grid = F.sequence(F.lit(0), F.lit(length - 1))
    return F.when(n == 0, F.array_repeat(F.lit(0.0), length)).when(n == length, F.transform(a, lambda v: v.cast("double"))).otherwise(F.transform(grid, at))


def interpolated(a: Column, length: int, mode: str = "left", force: bool = False) -> Column:
    """Longer signals are truncated unless ``force``; shorter ones are resampled."""
    if force:
        return resampled(a, length)
    return F.when(F.size(a) > length, F.transform(truncated(a, length, mode), lambda v: v.cast("double"))).otherwise(resampled(a, length))


def band_edges(fc: Column, fs: Column, width: float) -> tuple[Column, Column]:
    """Edges fc (1 -+ width / 2), held between 1 Hz and 0.999 of the Nyquist frequency. Where they cross: fc less and plus the
    smaller of a hundredth of the Nyquist frequency and half of fc, held likewise; where those cross too, the octave below the upper edge."""
    nyquist = fs / 2

    def held(half: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(1.0), fc - half), F.least(0.999 * nyquist, fc + half)

    (low, high), (near_low, near_high) = held(fc * (width / 2)), held(F.least(0.01 * nyquist, 0.5 * fc))
    crossed = low >= high
    low, high = F.when(crossed, near_low).otherwise(low), F.when(crossed, near_high).otherwise(high)
    return F.when(low < high, low).otherwise(F.greatest(F.lit(1.0), 0.5 * high)), high


def normalized(a: Column, m: Column, s: Column, low: Column, high: Column, mode: str, eps: float = 1e-8) -> Column:
    """With stored statistics: z-score divides by s + eps, min-max maps to [0, 1]."""
    if mode == "zscore":
        return bound(F.struct(m.alias("m"), s.alias("s")), lambda x: F.transform(a, lambda v: (v - x["m"]) / (x["s"] + eps)))
    if mode == "minmax":
        return bound(F.struct(low.alias("low"), high.alias("high")), lambda x: F.transform(a, lambda v: (v - x["low"]) / (x["high"] - x["low"] + eps)))
    return F.transform(a, lambda v: v.cast("double"))


def self_normalized(a: Column, mode: str, eps: float = 1e-8) -> Column:
    """With own statistics: z-score with the sample deviation, min-max to [-1, 1]."""
    if mode == "zscore":
        return bound(a, lambda a: bound(F.struct(mean(a).alias("m"), std(a, 1).alias("s")), lambda x: F.transform(a, lambda v: (v - x["m"]) / (x["s"] + eps))))
    return bound(a, lambda a: bound(F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high")), lambda x: F.transform(a, lambda v: 2 * (v - x["low"]) / (x["high"] - x["low"] + eps) - 1)))


def routed(fs: Column, windows: list[int], missing: str = "first") -> Column:
    """The window whose extent is nearest to the target; the first of equals. A missing fs gives the first or the smallest window."""
    known = fs.isNotNull() & (fs > 0)
    rows = F.array(*[F.struct(F.abs(w * SPEED / (2 * fs) - TARGET_MM).alias("d"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(windows)])
    return F.when(known, F.array_min(rows)["w"]).otherwise(windows[0] if missing == "first" else min(windows))


def patches(a: Column, width: Column | int) -> Column:
    """Consecutive slices of ``width`` samples; the tail is dropped."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.transform(indices(F.floor(F.size(a) / width)), lambda i: F.slice(a, i * width + 1, width))


def midpoints_us(n: Column, width: Column, fs: Column, offset: Column | int = 0, scale: Column | None = None) -> Column:
    """Midpoints of n patches; empty without a positive rate and width. scale: of a resampled signal, whose patches have no offset."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    fine = fs.isNotNull() & (fs > 0) & (width > 0)
    at = (lambda i: (i * width + width / 2.0) * scale) if scale is not None else (lambda i: i * width + width / 2.0 + offset)
    return F.when(fine, F.transform(indices(n), lambda i: at(i) / fs * 1e6)).otherwise(F.array().cast("array<double>"))


def resampling(n_raw: Column, length: Column) -> Column:
    """Samples of the source for each sample of a signal resampled from n_raw to ``length`` on the grid of ``resampled``."""
    return F.when(length > 1, (n_raw - 1.0) / (length - 1.0)).otherwise(1.0)


def unit_patch(a: Column, least: float = 1e-6) -> Column:
    """A patch less its mean, over its sample deviation, which is at least ``least``."""
    return bound(a, lambda a: bound(F.struct(mean(a).alias("m"), F.greatest(std(a, 1), F.lit(least)).alias("s")), lambda x: F.transform(a, lambda v: (v - x["m"]) / x["s"])))


def padded(a: Column, length: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), length - F.size(a)).cast("int")))


def pad_mask(a: Column, length: Column) -> Column:
    return F.transform(indices(length), lambda i: i < F.size(a))


def elementwise_loss(d: Column, kind: str) -> Column:
    if kind == "l1":
        return F.abs(d)
    if kind == "l2":
        return d * d
    return F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def margin(a: Column, label: Column) -> Column:
    """Value of the label less the largest other one."""
    return F.get(a, label) - F.array_max(F.filter(a, lambda v, i: i != label))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
