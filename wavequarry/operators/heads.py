"""Linear heads fitted from sums that tasks make of their rows: regression of all outputs in one pass, classification by Newton steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.functions import arrays as A

#: Tasks that sum up what all tasks give before the driver gets it; Newton steps; the gradient at which they end, by row.
FAN_IN, STEPS, FLAT = 16, 50, 1e-8


def summed(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of what ``make`` gives for each task's rows, an array of ``size`` values; the driver gets ``FAN_IN`` arrays at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"s": pa.array([make(batches).astype("<f8").tobytes()], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), "<f8")
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary())})

    width = max(1, min(FAN_IN, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.mapInArrow(run, "s binary").repartition(width).mapInArrow(fold, "s binary").collect()
    return sum((np.frombuffer(r["s"], "<f8") for r in rows), np.zeros(size))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def design(df: DataFrame, vector: str, *targets: Column) -> tuple[DataFrame, int]:
    """Rows of 1, the vector and the targets, where none is null, and their width. Vectors of another length than the first are an error."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    width = 1 + (first[0] if first else 0)
    same = F.when(F.size(vector) == width - 1, F.col(vector).cast("array<double>")).otherwise(F.raise_error(F.lit("vectors differ in length")))
    x = F.concat(F.array(F.lit(1.0)), same, *[F.array(t.cast("double")) for t in targets])
    return df.where(F.col(vector).isNotNull()).select(x.alias("x")).where(~F.exists("x", lambda v: v.isNull())), width


def regression(df: DataFrame, targets: list[str], vector: str, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row per target) and biases of least squares, all targets from the sums of products of one pass. ``ridge`` holds weights, not biases, down.

    Without rows, and in directions in which the vectors don't vary, weights are 0."""
    rows, width = design(df, vector, *[F.col(t) for t in targets])
    size = width + len(targets)

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((size, size))
        for b in batches:
            x = matrix(b.column(0), size)
            total += x.T @ x
        return total.ravel()

    sums = summed(rows, make, size * size).reshape(size, size)
    held = sums[:width, :width] + ridge * np.diag(np.r_[0.0, np.ones(width - 1)])
    found = np.linalg.lstsq(held, sums[:width, width:], rcond=1e-12)[0].T
    return found[:, 1:], found[:, 0]


def probe(df: DataFrame, label: str, vector: str, ridge: float = 1e-3) -> tuple[list, np.ndarray, np.ndarray]:
    """Classes in order, weights (a row per class) and biases of multinomial logistic regression with ``ridge`` by row on all weights, by damped Newton steps.

    Each step is one pass: gradient, curvature and loss are sums over tasks. The classes are few. One class, or none, has weights 0."""
    classes = sorted(r[0] for r in df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(label).distinct().collect())
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1 if classes else F.lit(0)
    rows, width = design(df.where(F.col(label).isNotNull()), vector, number)
    k = len(classes)
    w = np.zeros((k, width))
    if k < 2:
        return classes, w[:, 1:], w[:, 0]
    size = 2 + k * width + (k * width) ** 2

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            n, loss, slope, curve = 0, 0.0, np.zeros((k, width)), np.zeros((k, width, k, width))
            for b in batches:
                rows_ = matrix(b.column(0), width + 1)
                x, y = rows_[:, :width], rows_[:, width].astype(int)
                z = x @ w.T
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                total = p.sum(1, keepdims=True)
                p /= total
                n, loss = n + len(x), loss + float((np.log(total[:, 0]) - z[np.arange(len(x)), y]).sum())
                d = p.copy()
                d[np.arange(len(x)), y] -= 1
                slope += d.T @ x
                for c in range(k):
                    for e in range(c, k):
                        m = (x * (p[:, c] * ((c == e) - p[:, e]))[:, None]).T @ x
                        curve[c, :, e] += m
                        if e > c:
                            curve[e, :, c] += m.T
            return np.r_[n, loss, slope.ravel(), curve.ravel()]

        s = summed(rows, make, size)
        n = max(s[0], 1)
        slope, curve = s[2 : 2 + k * width], s[2 + k * width :].reshape(k * width, k * width)
        return s[1] / n + ridge / 2 * float((w * w).sum()), slope / n + ridge * w.ravel(), curve / n + ridge * np.eye(k * width), n

    loss, slope, curve, _ = at(w)
    for _ in range(STEPS):
        if np.abs(slope).max() < FLAT:
            break
        step = np.linalg.solve(curve, slope).reshape(k, width)
        share = 1.0
        while True:
            near = at(w - share * step)
            if near[0] <= loss - 1e-4 * share * float(slope @ step.ravel()) or share < 1e-3:
                break
            share /= 2
        w, (loss, slope, curve, _) = w - share * step, near
    return classes, w[:, 1:], w[:, 0]


def residual_slopes(df: DataFrame, vector: str, residuals: Column, n: int) -> DataFrame:
    """Rows (output, j, slope): the sums of each of ``n`` residuals (an array column) times 1 (j = 0) and each element of the vector; what a fit makes 0."""
    rows, width = design(df, vector, *[F.get(residuals, F.lit(i)) for i in range(n)])

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((n, width))
        for b in batches:
            x = matrix(b.column(0), width + n)
            total += x[:, width:].T @ x[:, :width]
        return total.ravel()

    sums = summed(rows, make, n * width).reshape(n, width)
    return df.sparkSession.createDataFrame([(i, j, float(sums[i, j])) for i in range(n) for j in range(width)], "output int, j int, slope double")


def scores(vector: Column, weights: np.ndarray, biases: np.ndarray) -> Column:
    from wavequarry.operators.evaluate import linear_scores

    return linear_scores(vector, weights.tolist(), biases.tolist())


def probabilities(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / A.total(e))
