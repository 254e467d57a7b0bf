"""A two-dimensional overview of embeddings: a neighbour graph, and its smoothest coordinates by orthogonal iteration over the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.functions import scan

#: Random lines along which rows are put in order; how many rows ahead a row looks on each; iterations, and steps between orthogonalisations.
LINES, NEAR, ROUNDS, STEPS = 8, 4, 6, 3


def neighbour_graph(df: DataFrame, key: str, vector: str, lines: int = LINES, near: int = NEAR, seed: int = 42) -> DataFrame:
    """Edges (a, b, w), in both directions: rows that follow each other closely on one of the lines, weighted by a Gaussian of their distance.

    Rows are dealt by ranges of (line, place), so no task holds a line; no pairs but neighbours are made. Rows whose vector is null or not finite
    have no edges."""
    width = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if width is None:
        return df.sparkSession.createDataFrame([], "a long, b long, w double")
    directions = np.random.default_rng(seed).normal(size=(lines, width[0]))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL AND size(x) > 0")

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            at = x @ directions.T
            fine = np.flatnonzero(np.isfinite(at).all(1))
            for line in range(lines if len(fine) else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fine), line)), pa.array(at[fine, line]), b.column(0).take(pa.array(fine)), b.column(1).take(pa.array(fine))], names=["line", "at", "key", "x"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            line, keys, x = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            if held:  # the last rows of the batch before
                line, keys, x = (np.concatenate([h, v]) for h, v in zip(held, (line, keys, x)))
            done = len(held[0]) if held else 0
            for ahead in range(1, near + 1):
                i = np.arange(max(0, done - ahead), len(keys) - ahead)
                i = i[line[i] == line[i + ahead]]
                d = ((x[i] - x[i + ahead]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[i], keys[i + ahead])), pa.array(np.maximum(keys[i], keys[i + ahead])), pa.array(d)], names=["a", "b", "d"])
            held = line[-near:], keys[-near:], x[-near:]

    dealt = rows.mapInArrow(projected, "line long, at double, key long, x array<double>").repartitionByRange("line", "at", "key").sortWithinPartitions("line", "at", "key")
    pairs = scan.stored(dealt.mapInArrow(linked, "a long, b long, d double").where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d")), "pairs")
    spread = pairs.agg(F.avg("d")).first()[0] or 1.0
    weighted = pairs.withColumn("w", F.exp(-F.col("d") / (2 * spread)))
    return weighted.select("a", "b", "w").unionByName(weighted.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def sums_of(rows: DataFrame, *values: str) -> list[float]:
    return [v or 0.0 for v in rows.agg(*[F.sum(F.expr(v)) for v in values]).first()]


def orthonormal(rows: DataFrame, k: int) -> DataFrame:
    """``y`` with columns orthogonal to sqrt(degree) and each other and of length 1, by the sums of their products."""
    root = "sqrt(degree)"
    columns = [root, *[f"y[{i}]" for i in range(k)]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = sums_of(rows, *[f"{columns[i]} * {columns[j]}" for i, j in pairs])
    gram = np.zeros((k + 1, k + 1))
    for (i, j), s in zip(pairs, sums):
        gram[i, j] = gram[j, i] = s
    lower = np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(k + 1))
    mix = np.linalg.inv(lower)[1:]  # new columns from the old ones
    return rows.withColumn("y", F.array(*[sum((float(m) * F.expr(c) for m, c in zip(row, columns) if m), F.lit(0.0)) for row in mix]))


def spectral_layout(edges: DataFrame, k: int = 2, rounds: int = ROUNDS, steps: int = STEPS, seed: int = 42) -> DataFrame:
    """key, degree and y: ``k`` orthonormal coordinates that change least along the edges (the graph's leading vectors but the constant one), and
    ``quotients``: how much of each is kept by a step to the neighbours, largest first.

    Every step is a join of the edges with the coordinates and a grouped sum; by merging, as a broadcast would send the coordinates through the driver
    in each step. More columns than wanted are iterated, so that the wanted ones settle."""
    edges = scan.stored(edges, "edges")
    wide = k + 2
    start = F.array(*[F.rand(seed + i) - 0.5 for i in range(wide)])
    nodes = scan.stored(edges.groupBy(F.col("a").alias("key")).agg(F.sum("w").alias("degree")).withColumn("y", start), "nodes")
    for _ in range(rounds):
        for _ in range(steps):
            there = nodes.select(F.col("key").alias("b"), F.transform("y", lambda v: v / F.sqrt("degree")).alias("z"))
            moved = edges.join(there.hint("merge"), "b").groupBy(F.col("a").alias("key")).agg(*[F.sum(F.col("w") * F.col("z")[i]).alias(f"s{i}") for i in range(wide)])
            stepped = nodes.join(moved.hint("merge"), "key").select("key", "degree", F.array(*[(F.col("y")[i] + F.col(f"s{i}") / F.sqrt("degree")) / 2 for i in range(wide)]).alias("y"))
            nodes = scan.stored(stepped, "nodes")
        nodes = scan.stored(orthonormal(nodes, wide), "nodes")
    # within the iterated space: rotate to the axes of the step itself
    there = nodes.select(F.col("key").alias("b"), F.transform("y", lambda v: v / F.sqrt("degree")).alias("z"))
    moved = edges.join(there.hint("merge"), "b").groupBy(F.col("a").alias("key")).agg(*[F.sum(F.col("w") * F.col("z")[i]).alias(f"s{i}") for i in range(wide)])
    both = nodes.join(moved.hint("merge"), "key")
    pairs = [(i, j) for i in range(wide) for j in range(wide)]
    step = np.array(sums_of(both, *[f"y[{i}] * s{j} / sqrt(degree)" for i, j in pairs])).reshape(wide, wide)
    values, vectors = np.linalg.eigh((step + step.T) / 2)
    first = np.argsort(-values)[:k]
    turned = [sum((float(vectors[i, c]) * F.col("y")[i] for i in range(wide)), F.lit(0.0)) for c in first]
    return nodes.select("key", "degree", F.array(*turned).alias("y"), F.array(*[F.lit(float(values[c])) for c in first]).alias("quotients"))
